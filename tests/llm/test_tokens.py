"""Token counts, token alignment and the filter audit against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skerry.llm import alignment, common, filter_audit, language_id, quality_rules, sql, token_counts, toxicity
from tests.oracle import compare

PARTS = [" ", "  ", "\n", "\t", "\r\n", "▁", "the", "tion", "Water", "naïve", "日本語", "😀", "\x00", "　", " ", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "12345", "});", "e", ".", ",", "´", "ǆ"]


def texts(seed=3, n=60):
    r = random.Random(seed)
    out = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 30))) for _ in range(n)]
    return [None, "", " ", "  ", "\n", "▁", *out, out[0], out[1], "the cat sat on the mat. " * 9000, "x" * 60000, " " * 5000, "0123456789" * 700]


def frame(spark, values, ids=None):
    ids = list(range(len(values))) if ids is None else ids
    return spark.createDataFrame([(i, t, str(len(t or "") % 2) if t else None) for i, t in zip(ids, values, strict=True)], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_match_the_library(spark, library):
    values = texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.counted(frame(spark, values).repartition(3)).collect()}
    assert got == {i: (len((t or "").encode()), n := len(library[1].encode(t or "")), n > 4096) for i, t in enumerate(values)}
    assert token_counts.counted(frame(spark, [])).count() == 0


def test_token_counts_of_random_texts_and_long_words(library):
    c, r = token_counts.counter(), random.Random(11)
    for _ in range(3000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 16)))
        assert c.count(t) == len(library[1].encode(t)), t
    assert 30_000 < c.whole <= library[1].get_piece_size()


def test_token_counts_remember_no_more_than_there_is_room_for(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED", 30)
    c = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    before = len(c.spaced)
    t = " ".join(f"zq{i}xj" for i in range(200))
    assert c.count(t) == len(library[1].encode(t)) and len(c.spaced) < before + 10


def test_token_counts_keep_other_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 1, 2, 3, (4,)), (5, None, None, None, None, None)], "doc_id long, text string, `a``b` int, N_Tokens int, n_bytes int, s struct<`p-q`: int>")
    out = token_counts.counted(docs)
    assert out.columns == [*docs.columns, "n_bytes_", "n_tokens_", "over_limit"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(None, "a b", 1, 2, 3, (4,), 3, 2, False), (5, None, None, None, None, None, 0, 0, False)], key=str)


def align_brute(values, library):
    """Rows of op13 in the order of the texts, from its definition."""
    characters = alignment._byte_characters()
    docs, counts = [], Counter()
    for t in values:
        a_ids = library[0].encode(" " + t, add_special_tokens=False).ids if t else []
        b_ids = library[1].encode(t) if t else []
        a = [bytes(characters[c] for c in library[0].id_to_token(i)) for i in a_ids]
        b = []
        for i in b_ids:
            p = library[1].id_to_piece(i)
            b.append(bytes([int(p[3:5], 16)]) if library[1].is_byte(i) else p.replace("▁", " ").encode())
        data = (" " + t).encode() if t else b""
        if b"".join(a) != data or b"".join(b) != data:
            a_ids, b_ids, a, b = [], [], [], []

        def ends(tokens):
            out, n = [], 0
            for x in tokens:
                n += len(x)
                out.append(n)
            return out

        cuts = sorted(set(ends(a)) & set(ends(b)))
        groups = [([], []) for _ in cuts]
        for side, ids, tokens in ((0, a_ids, a), (1, b_ids, b)):
            for i, end in zip(ids, ends(tokens), strict=True):
                groups[next(k for k, c in enumerate(cuts) if c >= end)][side].append(i)
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(links.keys())
        docs.append((len(a_ids), len(b_ids), groups, links))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best = sum(n for p, n in links.items() if counts[p] == highest[p[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


SMALL = lambda: [t if t is None or len(t) < 9000 else t[:3000] for t in texts()]


@pytest.mark.parametrize("each", [alignment.SALT_POSTINGS, 7])
def test_alignment_matches_brute_force(spark, library, each, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 500)
    monkeypatch.setattr(alignment, "SALT_POSTINGS", each)
    values = SMALL()
    rows = alignment.alignment(frame(spark, values).repartition(3), each=each).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert [got[i] for i in range(len(values))] == align_brute(values, library)


def test_alignment_of_repeated_rows_null_ids_and_nothing(spark, library):
    values, ids = ["the cat", "the cat", "a dog", None], [7, 7, None, 8]
    extra = frame(spark, values, ids).selectExpr("*", "1 AS `a``b`", "2 AS Slot", "3 AS batch")
    got = sorted((tuple(r) for r in alignment.alignment(extra).collect()), key=str)
    assert got == sorted(((i, *row) for i, row in zip(ids, align_brute(values, library), strict=True)), key=str)
    assert alignment.alignment(frame(spark, [])).count() == 0
    assert alignment.alignment(frame(spark, [None, "", "a▁b"])).where("n_a = 0 AND n_links = 0 AND groups_sha256 = ''").count() == 3


def test_large_groups_are_counted_by_distinct_ids(monkeypatch, library):
    s = alignment.sides()
    values = [t for t in SMALL()]
    whole = alignment.aligned(values, s)
    monkeypatch.setattr(alignment, "LINKS_EACH", 1)
    few = alignment.aligned(values, s)
    assert all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(whole, few, strict=True))


def test_both_libraries_of_side_a_agree(library):
    r, s = random.Random(5), alignment.sides()
    plain = [p for p in [*PARTS, "Ünß", "don't", "we'll ", "«x»", "§", "³", "½", "  \n "] if alignment._PLAIN.fullmatch(p)]
    for _ in range(3000):
        t = "".join(r.choice(plain) for _ in range(r.randint(0, 20)))
        assert s.encode_a(t) == library[0].encode(t, add_special_tokens=False).ids, t


def audit_brute(rows, labels):
    """Rows of op11 from its definition, one order and document at a time."""
    texts_of = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts_of[t or ""].append(i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        words = [w for w in t.translate({ord(c): " " for c in "\t\n\r\x0b\x0c"}).split(" ") if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j < i for j in texts_of[t]),
        }
        mine = [r for r in labels if r[0] == i and i is not None]
        docs.append((part or "", {k for k, v in fails.items() if v}, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [d for d in docs if d[0] == part], []
            for step, x in enumerate(order, 1):
                lost = [d for d in left if x in d[1]]
                redundant = sum(x in d[1] for d in gone)
                left = [d for d in left if x not in d[1]]
                gone += lost
                shapley[part, x] += len(lost)
                out[part, order, step] = [len(left), len(lost), redundant, sum(d[1] == {x} for d in docs if d[0] == part), sum(d[2] for d in lost), sum(d[3] for d in lost)]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def audit_case():
    r = random.Random(8)
    rows = []
    for i in range(120):
        t = " ".join(r.choice(["ab", "cd", "Ef", "#g", "HI", "k l"] + [f"w{k}" for k in range(90)]) for _ in range(r.choice([5, 49, 50, 60, 120])))
        rows.append((i, t, r.choice(["x", "y", None, ""])))
    rows += [(r.choice([i, 200 + i, None]), rows[i % 7][1], r.choice(["x", "y"])) for i in range(60)] + [rows[3], rows[3], (300, None, "x"), (301, "", "z"), (None, None, None), (301, "", "z")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 200, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def test_filter_audit_matches_brute_force(spark, monkeypatch):
    rows, labels = audit_case()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS `a``b`", "3 AS mask").repartition(3)
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in found.collect()) == audit_brute(rows, labels)
    monkeypatch.setattr(filter_audit, "HELD", 1)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_filter_audit_tells_texts_of_one_fingerprint_apart(spark, monkeypatch):
    chains = filter_audit.Chains()
    told = [*chains.add(1, b"a", 5, 0, [("p", 1)]), *chains.add(1, b"b", 6, 0, [("p", 1)]), *chains.add(1, b"a", 4, 0, [("q", 2)]), *chains.add(1, b"a", 9, 0, [("q", 1)])]
    assert told == [(5, "p", filter_audit.COPY, 1), (9, "q", filter_audit.COPY, 1)]
    assert list(chains.drain()) == [(1, b"a", 4, 0, [("q", 2)]), (1, b"b", 6, 0, [("p", 1)])] and chains.bytes == 0


def test_filter_audit_sends_texts_in_several_loads(monkeypatch):
    rows, _ = audit_case()

    def settle(routed):
        return _merged(filter_audit._settle(routed))

    given = [(i, p or "", t or "") for i, t, p in rows]
    whole = settle(list(filter_audit._route(given)))
    monkeypatch.setattr(filter_audit, "HELD", 300)
    assert settle(list(filter_audit._route(given))) == whole


def _merged(told):
    out = Counter()
    for doc, part, mask, n in told:
        out[doc, part, mask] += n
    return out


ODD = "doc_id long, text string, lang string, source string, `a``b` int, `a.b` int, s struct<`p-q`: int>, LANG_PRED int, Toxicity string, Clean_Text int"


def odd(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, (3,), 4, "t", 5) for r in rows], ODD)


def kept_columns(df, *replaced):
    return [c for c in df.columns if c.lower() not in replaced]


def test_columns_of_any_name_and_type_stay(spark):
    rows = [(i, f"the cat {i} sat here" if i % 2 else f"der Hund {i} liegt dort", "en" if i % 2 else "de", "s") for i in range(40)] + [(None, None, None, None)]
    docs, labels = odd(spark, rows), spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    out = language_id.predict(docs, language_id.fit(docs))
    assert out.columns == [*kept_columns(docs, "lang_pred"), *language_id.NAMES]
    assert {tuple(r)[4:7] for r in out.select(*common.columns(kept_columns(docs, "lang_pred"))).collect()} == {(1, 2, (3,))} and out.count() == 41
    scored = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert scored.columns == [*kept_columns(docs, "toxicity"), "toxicity"] and scored.count() == 41
    clean = quality_rules.cleaned(docs)
    assert clean.columns == [*kept_columns(docs, "clean_text"), "clean_text"] and sorted(r["text"] or "" for r in clean.collect()) == sorted(r[1] or "" for r in rows)
    assert clean.where("text IS DISTINCT FROM clean_text").count() == 0
    for empty in (language_id.predict(docs.limit(0), None), toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)), quality_rules.cleaned(docs.limit(0))):
        assert empty.count() == 0


def test_lines_are_one_in_python_and_sql_and_depleted_documents_go(spark, tmp_path):
    """Lines that begin with other blanks than ASCII's are lines of their own; a document that
    passes the base rules is rejected for what is left of it, by the limits of production."""
    plain = " ".join(f"word{k}" for k in range(60))
    notice = " ".join(f"notice{k}" for k in range(70))
    rows = [(i, f"{b}All rights reserved here\n{plain} {i}", "en", "h") for i, b in enumerate([" "] * 8 + [" "] * 3)]
    rows += [(20 + i, f"{notice}\nown{i} own own", "en", "g") for i in range(6)] + [(40 + i, f"{plain} {i} Ünique ÜNIQUE\nÜX", "en", "g") for i in range(90)] + [(200, "ÜX\nüX", "en", "g"), (201, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "data" / "documents.parquet"))
    got = {r["doc_id"]: r for r in quality_rules.op10_quality_rules(spark, str(tmp_path / "data")).collect()}
    assert [got[i]["n_removed_lines"] for i in range(11)] == [1] * 8 + [0] * 3
    assert all(not got[20 + i]["base_failed"] and not got[20 + i]["kept"] and got[20 + i]["n_left_words"] == 3 for i in range(6))
    assert all(got[40 + i]["kept"] for i in range(90))
    (tmp_path / "flat").mkdir()
    docs.toPandas().to_parquet(tmp_path / "flat" / "documents.parquet")
    compare(spark, quality_rules.op10_quality_rules, sql.OP10, tmp_path / "flat")
