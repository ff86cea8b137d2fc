"""Corpus operators against brute force, on small fixtures with the awkward cases:
nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import chat_format, decontaminate, language_id, packing, pii, quality_rules, simhash, suffix_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, uid string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0.5, "u") for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "re", "on", "in", "st", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward():
    base = prose(1, 300)
    return [base, None, "", " \n\t", base, base[:900] + "! " + prose(2, 80), prose(3, 5000), "a" * 5000, "é" * 200 + base[100:400], prose(4, 30), prose(4, 30), "x"]


def suffix_brute(texts, ids=None):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row; a string is earlier by (id, start)."""
    ids = list(range(len(texts))) if ids is None else ids
    first, out = {}, []
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        for s in range(len(b) - 99):
            first[b[s:s + 100]] = min(first.get(b[s:s + 100], (i, s)), (i, s))
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s:s + 100]] < (i, s):
                gone[s:s + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def suffix_rows(docs):
    return sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.deduplicated(docs).collect())


def test_suffix_dedup_matches_brute_force(spark):
    texts = awkward()
    assert suffix_rows(frame(spark, texts)) == suffix_brute(texts)
    assert suffix_dedup.deduplicated(frame(spark, [])).count() == 0


def test_suffix_dedup_of_repeated_rows_and_ids(spark):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    texts = [a, a, b + a, c, c[:300] + b, c[:300] + b, "z" + c, c + c, None, b]
    ids = [1, 1, 1, 2, 2, 2, 2, 2, 3, 3]
    assert suffix_rows(frame(spark, texts, ids).repartition(3)) == suffix_brute(texts, ids)
    both = [a, a, b]
    assert [r[2] for r in suffix_rows(frame(spark, both, [5, 5, 5]))] == [0, 0, 0]
    rows = suffix_dedup.deduplicated(frame(spark, [a, a], [None, 4])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {None: 0, 4: len(a)}


def test_suffix_dedup_splits_hot_anchors_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    passage = prose(9, 40)
    texts = [prose(100 + i, 3 + i % 7) + " " + passage[: 120 + i] + prose(200 + i, 5) for i in range(40)] + [prose(9, 2000) * 2]
    assert suffix_rows(frame(spark, texts).repartition(4)) == suffix_brute(texts)


@pytest.mark.parametrize("dealt", [1, 8])
def test_suffix_dedup_of_one_passage_in_many_texts(spark, monkeypatch, dealt):
    """The runs of a passage share all their bytes; null ids and starts that tie are among them."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "DEALT", dealt)
    monkeypatch.setattr(suffix_dedup, "MERGED", 2)
    passage, exact = prose(9, 40)[:160], prose(8, 40)[:100]
    texts = [f"{i:x}" * (1 + i % 3) + passage + prose(200 + i, 4) for i in range(60)] + [prose(300 + i, 2) + exact + f"{i:x}!" for i in range(60)]
    texts += [f"{i:04d}" + passage + f"{i:04d}" for i in range(30)]
    ids = [*range(120), *[120] * 30]
    assert suffix_rows(frame(spark, texts, ids).repartition(4)) == suffix_brute(texts, ids)
    rows = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.deduplicated(frame(spark, texts[:40], [None, *range(39)])).collect()}
    assert rows[None] == 0 and all(n >= 160 for i, n in rows.items() if i is not None)


def test_suffix_dedup_holds_no_more_than_a_bound_of_a_group(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    r = random.Random(4)
    sizes = [r.choice([1, 2, 5, 6, 40]) for _ in range(60)]
    anchor = np.repeat(np.arange(60), sizes)
    t = pa.table({"anchor": anchor, "salt": np.zeros(len(anchor), np.int32), "kind": np.zeros(len(anchor), np.int8)})
    seen = []
    for table, hot in suffix_dedup.bounded_groups(iter(t.to_batches(max_chunksize=7))):
        assert table.num_rows <= 5 + 7
        seen += zip(table.column("anchor").to_pylist(), hot.tolist(), strict=True)
    assert [a for a, _ in seen] == anchor.tolist() and all(h == (sizes[a] > 5) for a, h in seen)
    met = [(a, h) for b in suffix_dedup._met(iter(t.to_batches(max_chunksize=7))) for a, h in zip(b.column("anchor").to_pylist(), b.column("hot").to_pylist(), strict=True)]
    assert met == [(a, sizes[a] > 5) for a in anchor.tolist() if sizes[a] > 1]


def test_suffix_dedup_with_many_contexts_of_one_passage(spark):
    passage = prose(9, 40)
    texts = [prose(100 + i, 3 + i % 7) + " " + passage[: 120 + i] + prose(200 + i, 5) for i in range(60)]
    assert suffix_rows(frame(spark, texts)) == suffix_brute(texts)


def test_deep_shallow_sort_orders_suffixes():
    r = random.Random(3)
    data = bytes(r.choice(b"ab") for _ in range(400)) * 2 + b"a" * 300 + b"\0" * 100
    starts = np.array(r.sample(range(len(data) - 100), 500))
    order, equal = suffix_dedup.deep_shallow_sort(data, starts, np.zeros(500, int), 100)
    windows = [data[starts[i]:starts[i] + 100] for i in order]
    assert windows == sorted(windows)
    assert equal.tolist() == [False] + [a == b for a, b in zip(windows, windows[1:], strict=False)]


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_simhash_matches_brute_force(spark):
    texts = awkward() + [prose(50, 400) + f" v{i}" for i in range(25)] + ["ÀB Àb", "the the the the the the"]
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.components(frame(spark, texts)).collect()}
    fps = [simhash_brute(t) for t in texts]
    roots = components_brute(fps)
    assert got == {i: (f, r) for i, (f, r) in enumerate(zip(fps, roots, strict=True))}
    assert sorted(r["doc_id"] for r in simhash.deduplicated(frame(spark, texts)).collect()) == sorted(set(roots))
    assert simhash.components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [40, 3000])
def test_trie_join_loses_no_link(n):
    r = random.Random(n)
    centre = [r.getrandbits(64) for _ in range(5)]
    fps = list({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centre for _ in range(n // 5)})
    a, b = simhash.trie_links(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    at = {f: i for i, f in enumerate(fps)}
    root = simhash._label(len(fps), np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]), np.arange(len(fps)))
    array = np.array(fps, np.uint64)
    u, v = np.nonzero(np.triu(np.bitwise_count(array[:, None] ^ array[None]) <= 4, 1)) if len(fps) < 4000 else ([], [])
    want = simhash._label(len(fps), u, v, np.arange(len(fps)))
    assert (root == want).all() and len(a) < len(fps)


def test_block_keys_cover_every_link():
    r = random.Random(5)
    for n in (100, 1 << 26, 1 << 34):
        keys = simhash.block_keys(n)
        for _ in range(200):
            x = r.getrandbits(64)
            y = x ^ sum(1 << b for b in r.sample(range(64), 4))
            assert any(all((x >> low) % (1 << w) == (y >> low) % (1 << w) for low, w in choice) for choice in keys)


def test_packing_is_whole_and_gapless(spark):
    texts = awkward() + [prose(70 + i, 20 + 13 * i) for i in range(60)] + ["<|endoftext|> tag", "½ Ⅷ ١٢ ｆ", "DON'T it's"]
    docs = frame(spark, texts, [*range(len(texts) - 1), None])
    rows = packing.packed(docs, capacity=256, keep_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for i, text in zip([*range(len(texts) - 1), None], texts, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i])
        assert [p[2] for p in pieces[:-1]] == [256] * (len(pieces) - 1)
        assert b"".join(p[3] for p in pieces) == np.array(ids, "<u4").tobytes()
    assert len(by_sequence) <= 1.06 * sum(r["length"] for r in rows) / 256 + 1
    assert packing.packed(frame(spark, [])).count() == 0


def test_packing_plan_keeps_every_piece():
    r = random.Random(1)
    for _ in range(20):
        h = {r.randint(1, 100): r.randint(1, 50) for _ in range(r.randint(1, 40))}
        made = packing.plan(h, 100, groups=6)
        count = {}
        for space, times, content in made.kinds:
            assert space == 100 - sum(a * b for a, b in content) >= 0
            for a, b in content:
                count[a] = count.get(a, 0) + b * times
        assert count == h


def decontamination_brute(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, found = word(t), set(), set()
        for i, item in items:
            x = word(item)
            k = min(10, len(x))
            windows = {tuple(x[j:j + k]) for j in range(max(1, len(x) - 9))} if x else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in windows:
                    hit.update(range(j, j + k))
                    found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_matches_brute_force(spark):
    item = prose(20, 25)
    items = [(1, item), (10, item.upper()), (2, "two words"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (5, "the the the the the the the the the the the")]
    texts = [f"x {item} y", item[:120], "TWO-words, two words", None, "", "the " * 30, prose(21, 3000) + " " + item + " " + item, "äTwo wordsä"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in decontaminate.report(docs, bench).collect()}
    want = decontamination_brute(texts, items)
    assert got == dict(enumerate(want))
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, w in enumerate(want) if not w[-1]]
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_proximity_matches_are_confirmed_by_the_whole_window(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = item.split()
    texts = [
        item, " ".join([*w[:5], "and", "so", *w[5:]]), " ".join([*w[:3], "x", *w[4:]]), f"{w[0]} " + "z " * 40 + w[9], " ".join(reversed(w)),
        f"{w[0]} {w[1]} q q q q q q q {w[9]}", item + " " + " ".join([*w[:5], "and", *w[5:]]), None,
    ]
    rows = decontaminate.report(frame(spark, texts + ["filler " * 3 + " ".join(w[2:8])] * 3), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    got = {r["doc_id"]: (r["contaminated"], r["n_near"]) for r in rows}
    assert [got[i] for i in range(8)] == [(True, 0), (False, 1), (False, 1), (False, 0), (False, 0), (False, 0), (True, 0), (False, 0)]


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", 1, "b", 2, "c"), (2, "two words", "a", 1, "b", 2, "c")], "doc_id long, text string, words string, n_hit int, doc string, candidates int, near string")
    out = decontaminate.clean(docs, spark.createDataFrame([(1, "two words")], "item_id long, text string"))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "one two three", "a", 1, "b", 2, "c")]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_brute(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base_spans_match_the_patterns(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("0123456789+-. ()@ab_") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "4111 1111-1111 1111 é 😀 jo@x.example.com a@b.c_d@e.f", "1" * 30_000, "1 " * 5000, "a" * 30_000 + "@", "+1 (017) 555-7713", "0255.01.1.1 256.1.1.1 1.2.3.4.5.6.7.8"]
    rows = pii.tagged(frame(spark, texts), None).select("doc_id", "pii_base").collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in row["pii_base"]] == pii_brute(texts[row["doc_id"]])


def test_pii_model_and_redaction(spark):
    r = random.Random(2)
    def card():
        body = [r.randint(0, 9) for _ in range(15)]
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(body))
        return "".join(map(str, body)) + str(-total % 10)
    texts = [f"pay card {card()} or call +1 (555) 555-{i:04d} é" for i in range(90)] + [f"order 20240101{i:06d}77 lot" for i in range(90)] + [None]
    docs = frame(spark, texts)
    model = pii.fit(docs)
    out = {x["doc_id"]: x for x in pii.redacted(docs, model).collect()}
    assert out[0]["text"] == "pay card [CARD] or call [PHONE] é" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[180]["text"] is None and pii.redacted(docs, model).columns == docs.columns
    x = np.array([[f, 1.0] + [0.0] * (len(pii.FEATURES) - 2) for f in (0, 0, 1, 1)] * 100)
    assert pii.fit_trees(x, np.ones(400)) is None
    assert pii.fit(docs.limit(0)) is None


def test_chat_format_round_trips(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\|im_end|> <|im_end|>", "[\\\\INST]", None, "", "naïve 😀 <<SYS>>", "a\nb " * 3000, "<</SYS>><s>"]
    rows = [(i // 3, i % 3, ["user", "assistant", None][i % 3], t) for i, t in enumerate(hard * 3)] + [(99, 1, "assistant", "same"), (99, 1, "assistant", "same"), (None, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat_format.digest_conversations(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: r[1])
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"], got[conv]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))
    for t in hard:
        e = chat_format.escape(t or "")
        assert chat_format.unescape(e) == (t or "") and not any(c in e for c in chat_format.CONTROL)


def test_warc_round_trip_and_verification(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 100_000, "<p>b</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, "extra") for i, h in enumerate(html)] + [(None, None, "<p>b</p>", "e")], "page_id long, url string, html string, payload string")
    rows = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}"), f"file://{tmp_path}").collect()}
    assert len(rows) == 7
    assert [(rows[i]["record_type"], rows[i]["refers_to"]) for i in (0, 1, 2, 3, 5, None)] == [("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("response", None), ("revisit", 5)]
    for i, h in enumerate(html):
        b = (h or "").encode()
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    assert bytes(rows[4]["payload"]).decode() == html[4]
    good = warc.record(1, "u", b"hello", None, False)
    read = lambda b: [warc.read_record(m) for m in warc.members(io.BytesIO(b))]
    assert len(read(warc.member(good) * 3)) == 3
    for broken in (warc.member(good.replace(b"hello", b"hullo")), warc.member(good)[:-20], warc.member(good[:-1])):
        with pytest.raises(warc.WarcError):
            read(broken)


def test_quality_rules_match_brute_force(spark):
    texts = awkward() + ["spam line here\n" + prose(90 + i, 60) for i in range(6)] + ["spam line here\n" * 20] + ["a b c a b c a b c " * 10]
    got = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.statistics(frame(spark, texts)), line_limit=4).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        hit = {k for j, x in enumerate(tri) if tri.count(x) > 1 for k in range(j, j + 3)} if len(tri) < 1000 else None
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(x in lines[:k] for k, x in enumerate(lines)))
        if hit is not None:
            assert r["n_repeat_words"] == len(hit)
    assert got[12]["n_left_words"] == got[12]["n_words"] - 3 and got[12]["kept"] and not got[18]["kept"]
    cleaned = {r["doc_id"]: r["clean_text"] for r in quality_rules.cleaned(frame(spark, texts), line_limit=4).collect()}
    assert cleaned[12] == texts[12].split("\n", 1)[1] and cleaned[1] is None
    assert quality_rules.judge(quality_rules.statistics(frame(spark, []))).count() == 0


def test_language_id(spark):
    words = {"aa": "the and of that with from this have", "bb": "der die und nicht mit von eine für", "cc": "que los para con una por más está"}
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(w.split(), k=40)), lang) for i in range(60) for lang, w in words.items()]
    docs = spark.createDataFrame([(k, t, x) for k, (_, t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1000, None, None), (1001, "", None), (1002, "123 ... !", None)], "doc_id long, text string, lang string")
    out = {x["doc_id"]: x for x in language_id.predict(docs.unionByName(odd), model).collect()}
    assert np.mean([out[k]["lang_pred"] == x for k, (_, _, x) in enumerate(rows)]) == 1
    assert all(out[k]["lang_pred"] == "und" and out[k]["lang_score"] == 0 for k in (1000, 1001, 1002))
    assert language_id.predict(docs, language_id.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    codes = language_id.codewords(9)
    assert len({tuple(c) for c in codes.tolist()}) == 9


def test_toxicity_restores_and_scores(spark):
    bad = ["idiot", "moron", "scum"]
    texts = [prose(300 + i, 60) + (f" {bad[i % 3]} " if i % 4 == 0 else " ") + prose(600 + i, 30) for i in range(160)]
    docs = frame(spark, [*texts, prose(1, 40) + " 1d10t", prose(1, 40) + " m o r o n", None, prose(1, 40)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(0, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    s = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs, model).collect()}
    assert np.mean([(s[i] >= 0.7) == (i % 4 == 0) for i in range(160)]) > 0.97
    assert s[160] >= 0.7 and s[161] >= 0.7 and s[162] < 0.7 and s[163] < 0.7
    assert toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).where("toxicity > 0.1").count() == 0


def test_pii_fit_on_few_documents_leaves_base_spans(spark):
    docs = spark.createDataFrame([(i, f"write to a{i}@b.org or call +49 30 123456{i % 10}0") for i in range(60)], "doc_id long, text string")
    few = {r["doc_id"]: r["pii_base"] for r in pii.tagged(docs, pii.fit(docs, documents=10)).collect()}
    assert few == {r["doc_id"]: r["pii_base"] for r in pii.tagged(docs, None).collect()} and all(len(v) == 2 for v in few.values())


def test_near_copies_beyond_four_bits_are_dropped(spark):
    def changed(text, seed, times):
        w, r = text.split(), random.Random(seed)
        for i in r.sample(range(0, len(w), 6), times):
            w[i] = f"changed{r.random()}"
        return " ".join(w)

    def shingles(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    texts = [changed(prose(900 + k, 300), 10 * k + j, 4 * (j > 0)) for k in range(30) for j in range(3)]
    texts += [changed(texts[0], 5000 + j, 6) for j in range(40)]  # many are similar to some, not to all
    root, sets = list(range(len(texts))), [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    far = [bin(simhash.fingerprint(texts[3 * k]) ^ simhash.fingerprint(texts[3 * k + 1])).count("1") for k in range(30)]
    assert max(far) > 4 and len(set(root)) == 30
    assert sorted(r["doc_id"] for r in simhash.deduplicated(frame(spark, texts)).collect()) == sorted(set(root))


def test_bucket_links_connect_what_the_smallest_does_not():
    sets = [np.arange(i * 8, i * 8 + 100) for i in range(6)] + [np.arange(5000, 5100)]
    label = np.arange(7)
    for a, b in simhash.bucket_links(sets, label):
        label[label == label[b]] = label[a]
    assert len(set(label[:6].tolist())) == 1 and label[6] == 6


def test_texts_that_share_an_id_are_judged_apart(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = simhash.deduplicated(frame(spark, [a, b, a, a, b, None, None], [1, 1, 1, 2, None, None, 3])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted([(1, a), (1, b), (None, b), (None, None), (3, None)], key=str)


def test_quality_rules_judge_equal_line_shares_alike(spark):
    rows = []
    for host, n in (("small", 40), ("large", 1200)):
        for i in range(n):
            common = "shared menu line of the host\n" if i % 8 == 0 else ""
            whole = "cookie notice words repeat everywhere\n" * 20 if i % 8 == 0 else ""
            rows.append((len(rows), common + whole + prose(i, 10 if whole else 60), host))
    rows.append((len(rows), "rare line\n" + prose(5, 60), "large"))
    rows.append((len(rows), "rare line\n" + prose(6, 60), "large"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r["doc_id"]: r["n_removed_lines"] for r in quality_rules.judge(quality_rules.statistics(docs)).collect()}
    assert all(removed[i] == 2 * (t.startswith("shared")) for i, t, _ in rows)
    few = quality_rules.statistics(docs.where("source = 'small'").limit(3))
    assert quality_rules.frequent_lines(few).count() == 0


def test_pii_adds_written_out_addresses_and_phones_without_plus(spark):
    texts = [f"please write to ann{i}@mail{i % 7}.example.com or call +49 30 {1234567 + i} today" for i in range(120)]
    texts += [f"order 20240101{i:06d}77 lot {i:04d}-{i * 7 % 10000:04d}-{i:04d} of @ all" for i in range(120)]
    new = ["write to bob (at) host (dot) com soon", "please call 49 30 7654321 today", "order 2024010100000177 lot"]
    docs = frame(spark, [*texts, *new])
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs, pii.fit(docs)).collect()}
    assert [out[240 + i] for i in range(3)] == ["write to [EMAIL] soon", "please call [PHONE] today", new[2]]


def test_toxicity_restores_long_and_short_disguises():
    plain = "you are such a worthless stupid moron and this is what the others said about fucking ass people in the house "
    model = toxicity.CharacterModel(toxicity.trigram_counts([plain] * 200))
    words = toxicity.Restorer(model).words
    assert "stupid" in words("x st" + "u" * 200 + "pid y")
    assert {"worthless", "moron"} <= words("x1 " + " ".join("youaresuchaworthlessstupidmoron") + ".")
    assert "moron" in words("m o r o n") and "fucking" in words("f***ing") and "ass" in words("an a$$.")
    assert words("a " * 3000 + "b")


def test_viterbi_matches_enumeration_of_the_lattice():
    plain = "you are such a stupid idiot and a moron said the others about fucking scum in the house of the king "
    model = toxicity.CharacterModel(toxicity.trigram_counts([plain] * 50))
    index = {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}

    def score(way):
        s, p, q = sum(c for _, c in way), 0, 0
        for ch in "".join(t for t, _ in way):
            s, p, q = s + model.log[p, q, index.get(ch, 0)], q, index.get(ch, 0)
        return s + model.log[p, q, 0]

    for token in ("1d10t", "m0r0n", "$cum", "stuuupid", "s t u p 1 d", "|d!0t", "f*ck", "a1!"):
        ways = list(itertools.product(*toxicity.lattice(token)))
        best = max(map(score, ways))
        found = [w for w in ways if abs(score(w) - best) < 1e-9]
        assert toxicity.decode(token, model) in {"".join(t for t, _ in w) for w in found}
    assert toxicity.decode("%%", model) == ""


def test_language_decoding_matches_a_plain_version():
    r = random.Random(6)
    texts = [prose(i, 20).encode() + "é ñ ü".encode()[: i % 7] for i in range(12)] + [b"", b"a", "Ünï".encode()]
    counts = np.array([[r.randint(0, 30) for _ in range(language_id.BUCKETS)] for _ in range(5)], float)
    model = language_id.train(list("abcde"), counts)
    best, share = language_id.decode(model, texts)
    for i, t in enumerate(texts):
        x = b"  " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t) + b"    "
        z, n = np.zeros(model.weights.shape[1]), 0
        for j in range(1, len(t) + 3):
            if x[j] != 32:
                code = ((x[j - 1] * 0x9E3779B1 ^ x[j] * 0x85EBCA6B ^ x[j + 1] * 0xC2B2AE35) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF
                z, n = z + model.weights[code >> 18].astype(float), n + 1
        loss = [float((np.exp(-np.clip(language_id.SCALE * z / max(n, 1) * c, -20, 20)) * model.bit_weights).sum()) for c in model.codes]
        assert min(loss) == pytest.approx(loss[best[i]])
        assert share[i] == pytest.approx((1 / min(loss)) / sum(1 / x for x in loss))


def test_trees_as_columns_match_their_numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (400, len(pii.FEATURES))).astype(float)
    x[:, 0] = rng.integers(0, 5, 400)
    model = pii.fit_trees(x, (x[:, 3] + x[:, 5] > 11).astype(float))
    names = list(pii.FEATURES)
    rows = spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(x[:60])], "i int, " + ", ".join(f"{n} int" for n in names))
    from pyspark.sql import functions as F

    got = [r["z"] for r in rows.select("i", F.struct(*names).alias("c")).select("i", model.column(F.col("c")).alias("z")).orderBy("i").collect()]
    assert np.allclose(got, model.raw(x[:60]))


def test_running_sums_over_blocks_match_plain_ones(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    values = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 500, 20_000)]
    rows = spark.createDataFrame([(v,) for v in values], "v array<long>")
    out = rows.select(pii.running(F.col("v"), 0, lambda a, b: a + b).alias("s"), pii.running(F.col("v"), 0, F.greatest).alias("m")).collect()
    for v, row in zip(values, out, strict=True):
        assert row["s"] == [0, *itertools.accumulate(v)][: len(v)]
        assert row["m"] == [0, *itertools.accumulate(v, max)][: len(v)]


def test_secrets_of_any_length_are_proposed(spark):
    texts = [f"api_key = '{'aB3' * n}' end" for n in (6, 171, 172, 5000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", F.length(F.regexp_substr("t", F.lit(pii.GENERATORS["secret"]))).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in found] == [18, 513, 516, 15000]


def test_tables_are_broadcast_by_rows_and_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(["a" * 50, None], "t"), (None, None)], "w array<string>, term string")
    shown = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert shown(decontaminate.small(df)) and shown(decontaminate.small(df.limit(0)))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 100)
    assert not shown(decontaminate.small(df))


def test_archives_of_a_task_that_runs_again_have_names_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"x{i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    plan = warc.plan_records(pages).coalesce(1)
    first, again = ([r["path"] for r in warc.write_archives(plan, str(tmp_path / "warc")).collect()] for _ in range(2))
    assert first and not set(first) & set(again)


def test_pii_spans_beyond_the_base(spark):
    r = random.Random(5)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f'so token = "{key()}" is here, mail a{i}@b{i}.org' for i in range(60)] + [f"commit {key()} and order 20240101{i:06d}77" for i in range(60)]
    new = [f'my api_key: "{key()}"', f"commit {key()}", "plain words only", None, f'secret = "{key()}" ' * 400]
    docs = frame(spark, [*texts, *new, *new])
    model = pii.fit(docs)
    rows = {x["doc_id"]: x for x in pii.tagged(docs, model).collect()}
    kinds = [[s["kind"] for s in rows[120 + i]["pii_spans"]] for i in range(10)]
    assert kinds == [["secret"], [], [], [], ["secret"] * 400] * 2
    assert all([s["kind"] for s in rows[i]["pii_spans"]] == ["secret", "email"] for i in range(60))
    out = {x["doc_id"]: x["text"] for x in pii.redacted(docs, model).collect()}
    assert out[124] == 'secret = "[SECRET]" ' * 400 and out[122] == new[2] and out[123] is None
    odd = docs.limit(3).withColumnsRenamed({"spans": "new", "uid": "base", "source": "pii_base"})
    assert pii.redacted(odd, model).schema == odd.schema
    iban = "x GB82 WEST 1234 5698 7654 32 y GB83 WEST 1234 5698 7654 32"
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(iban,)], "t string").select(F.transform(pii.located(F.col("t"), pii.GENERATORS["iban"], "."), lambda m: pii._checked(pii.IBAN, m["match"], m["match"])).alias("ok")).first()["ok"]
    assert got == [1, 0]


def test_overlapping_and_dense_spans_are_masked_whole(spark):
    texts = ["1.2.3.4@x.example +1 555 555 5555", "a@b.co " * 700, "é 1.2.3.4 " * 300, ""]
    out = [x["text"] for x in pii.redacted(frame(spark, texts), None).orderBy("doc_id").collect()]
    assert out[0] in ("[EMAIL][IP] [PHONE]", "[IP][EMAIL] [PHONE]") and out[1] == "[EMAIL] " * 700 and out[2] == "é [IP] " * 300 and out[3] == ""


def test_long_texts_are_encoded_as_a_whole():
    enc = chat_format.encoding()
    for text in ("ab  cd\\n\\n  x " * 900, "a" * 5000, " " * 3000 + "x", "naïve 😀 don't " * 300):
        assert chat_format.encode_long(enc, text, 100) == enc.encode_ordinary(text)


def test_empty_tables_and_repeated_rows(spark):
    none, long = frame(spark, []), prose(3, 60_000)
    docs = frame(spark, [prose(1, 60), prose(1, 60), None, "", long, long], [1, 1, 2, 2, 3, 3])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = toxicity.scored(docs, model)
    assert scores.count() == 6 and scores.select("doc_id", "toxicity").distinct().count() == 3
    assert toxicity.scored(none, model).count() == toxicity.scored(none, toxicity.fit(none, labels)).count() == 0
    languages = language_id.fit(docs)
    found = language_id.predict(docs, languages)
    assert found.count() == 6 and found.select("doc_id", "lang_pred", "lang_score").distinct().count() == 3
    assert language_id.predict(none, languages).count() == 0 and language_id.fit(none) is None
    assert pii.tagged(none, None).count() == pii.redacted(none, pii.fit(none)).count() == 0
    assert pii.tagged(docs, None).count() == 6
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest_conversations(chat_format.format_turns(talks)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.plan_records(pages).count() == 0
    again = warc.plan_records(spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (0, "u", "x")], "page_id long, url string, html string"))
    assert sorted((r["page_id"], r["refers_to"], r["revisit"]) for r in again.collect()) == [(0, 1, True), (1, None, False), (1, None, False)]


CONTRACTS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op13_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_return_what_their_contracts_name(spark, name):
    from skerry.llm.registry import QUERIES

    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = [tuple(c.split(" ")) for c in CONTRACTS[name].split(", ")]
    assert rows.dtypes[: len(want)] == want
    assert rows.count() >= 1


def test_blind_trie_compares_stretches_and_not_bytes():
    reads = []

    class Counted(bytes):
        def __getitem__(self, at):
            reads.append(at)
            return super().__getitem__(at)

    data = Counted(b"x" * 90 + b"a" * 10 + b"x" * 90 + b"\0" * 10 + b"x" * 90 + b"a" * 10)
    assert suffix_dedup.blind_trie_order(data, [0, 100, 200], 32, 100) == ([1, 0, 2], [32, 90, 100])
    assert len(reads) < 20
