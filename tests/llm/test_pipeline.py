import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from skerry.llm import language_id, packing, pii, registry, simhash
from tests.llm.test_operators import decontamination_brute, pii_brute
from tests.oracle import compare

DATA = Path("/root/testdata/sf0.001")


def near_copies_brute(texts):
    """Indices that stay: the first of each component of five-word shingles with a Jaccard similarity of 0.8."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sorted(set(root))


def masked_brute(text):
    out, at = [], 0
    for start, _, end, kind in pii_brute(text):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    bench = spark.read.parquet(str(DATA / "benchmark.parquet")).toPandas()
    before, columns, stages = docs.orderBy("doc_id").toPandas(), docs.columns, dict(corpus_pipeline.STAGES)

    model = language_id.fit(docs.where(~language_id.held_out()))
    best, share = language_id.decode(model, [(t or "").encode() for t in before.text])
    seen = np.array([bool(re.search(r"[^\W\d_]", t or "")) for t in before.text])
    want = before[seen & (share >= language_id.AMBIGUOUS)]
    docs = stages["language_id"](spark, docs, str(DATA))
    now = docs.orderBy("doc_id").toPandas()
    assert docs.columns == columns and now.doc_id.tolist() == want.doc_id.tolist()
    assert now.lang.tolist() == [model.languages[i] for i in best[want.index]] and now.text.tolist() == want.text.tolist()

    want = now.iloc[near_copies_brute(now.text.tolist())]
    docs = stages["simhash_near_dedup"](spark, docs, str(DATA))
    now = docs.orderBy("doc_id").toPandas()
    assert docs.columns == columns and now.equals(want.reset_index(drop=True)) and len(now) < len(before)

    found = decontamination_brute(now.text.tolist(), list(zip(bench.item_id, bench.text, strict=True)))
    want = now[[not f[-1] for f in found]]
    docs = stages["benchmark_decontamination"](spark, docs, str(DATA))
    now = docs.orderBy("doc_id").toPandas()
    assert docs.columns == columns and now.equals(want.reset_index(drop=True))

    spans = pii.tagged(docs, pii.fit(docs)).orderBy("doc_id").toPandas()
    docs = stages["pii"](spark, docs, str(DATA))
    after = docs.orderBy("doc_id").toPandas()
    assert docs.columns == columns and after.doc_id.tolist() == now.doc_id.tolist()
    base_only = [len(a) == len(b) for a, b in zip(spans.pii_base, spans.pii_spans, strict=True)]
    assert sum(base_only) > 0.9 * len(now)
    for old, new, plain in zip(now.text, after.text, base_only, strict=True):
        assert not plain or new == masked_brute(old)
    assert (after.n_chars == after.text.str.len()).all()

    rows = stages["best_fit_packing"](spark, docs, str(DATA)).toPandas()
    tokens = packing.tokenizer().tokenizer
    for doc, own in rows.sort_values("piece").groupby("doc_id"):
        ids = tokens.encode(after.text[after.doc_id == doc].iloc[0], add_special_tokens=False).ids
        assert b"".join(map(bytes, own.ids)) == np.array([*ids, packing.END_ID], "<u4").tobytes()
    assert set(rows.doc_id) == set(after.doc_id)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= packing.CAPACITY


def test_run_applies_the_stages_in_order(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
    after = {r["doc_id"] for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, str(DATA))
    assert {r["doc_id"] for r in rows.select("doc_id").distinct().collect()} == after


def test_stages_bear_awkward_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, `words n` string"
    text = "the house and the others of the king said that it was so " * 8
    rows = [(1, text, "en", "s", 5, "x", "y"), (1, text, "en", "s", 5, "x", "y"), (2, None, "en", "s", None, "x", "y"), (None, text + "mail a@b.co", None, None, 3, "x", "y"), (3, "", "de", "s", 0, "x", "y")]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(DATA))
            assert docs.columns == columns
        n = docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).count() == n <= 3


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_near_duplicate_components_are_those_of_brute_force(spark):
    """All pairs that share one of the rarest shingles of each, which no pair at 0.8 does not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [set(x.tolist()) for x in simhash.near_sets([r["text"].encode() if r["text"] else None for r in rows])]
    freq = Counter(v for x in sets for v in x)
    root, index = list(range(len(rows))), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        rare = sorted(x, key=lambda v: (freq[v], v))
        near = {j for v in rare[: len(rare) - -(-4 * len(rare) // 5) + 1] for j in index[v]} if x else set(index[None])
        for j in near:
            if simhash.similar(len(x & sets[j]), len(x), len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for v in rare[: len(rare) - -(-4 * len(rare) // 5) + 1] if x else [None]:
            index[v].append(i)
    want = defaultdict(set)
    for i, r in enumerate(rows):
        want[find(i)].add(r["doc_id"])
    got = defaultdict(set)
    for r in simhash.near_components(docs).collect():
        got[r["component"]].add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and any(len(v) > 1 for v in want.values())


def test_near_copies_are_linked_by_their_fingerprints(spark):
    """Signatures of similar sets differ in few bits, of others in half; groups are the
    components of fingerprints within the distance among those that share a key."""
    r = np.random.default_rng(4)
    sets = []
    for n in (9, 40, 300):
        for _ in range(20):
            one = r.integers(0, 1 << 63, n, np.uint64)
            sets += [one, np.concatenate([one[: round(n * 8 / 9)], r.integers(0, 1 << 63, n - round(n * 8 / 9), np.uint64)])]
    signs = np.array([simhash.signature(np.unique(x)) for x in sets])
    bits = np.unpackbits(signs, axis=1)
    assert (bits[::2] != bits[1::2]).mean() < simhash.DIFFER and abs((bits[:-2:2] != bits[2::2]).mean() - 0.5) < 0.02

    tables, enough = simhash.key_tables(len(sets))
    far = (bits[:, None, : 64 * simhash.NEAR_WORDS] != bits[None, :, : 64 * simhash.NEAR_WORDS]).sum(axis=2)
    rows = [(i, signs[i].tobytes(), len(x)) for i, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, sign binary, size long")
    for distance in (simhash.NEAR_DISTANCE, 20, 0):
        want = Counter()
        for k, t in enumerate(tables):
            meet, done = defaultdict(set), set()
            for i, x in enumerate(sets):
                if k < enough or len(x) <= simhash.FEW:
                    meet[bits[i, t].tobytes()].add(i)
            for i in sorted(i for b in meet.values() if len(b) > 1 for i in b):
                group, grown = set(), {i}
                while grown > group:
                    group = grown
                    grown = group | {j for a in group for j in meet[bits[a, t].tobytes()] if far[a, j] <= distance}
                if len(group) > 1 and i not in done:
                    done |= group
                    want[frozenset(group)] += 1
        got = defaultdict(set)
        for row in simhash.near_groups(nodes, len(sets), distance).collect():
            got[row["key"]].add(row["node"])
        assert Counter(map(frozenset, got.values())) == want
    linked = {frozenset(g) for g in got.values()}
    pairs = simhash.near_groups(nodes, len(sets)).select("node").distinct().count()
    assert pairs == len(sets) and not linked


def edited_copies(n, seed=3):
    """Texts of 120 words, each a copy of one with up to 7 words replaced: some pairs are similar, all are linked."""
    r = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(n):
        words = list(base)
        for at in r.choice(120, int(r.integers(0, 8)), replace=False):
            words[at] = f"x{k}v{at}"
        texts.append(" ".join(words))
    return texts


def components_of_texts(texts):
    """Lists of indices, by comparing all pairs."""
    sets = [set(x.tolist()) for x in simhash.near_sets([t.encode() for t in texts])]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and simhash.similar(len(x & sets[j]), len(x), len(sets[j])):
                label = [label[j] if v == label[i] else v for v in label]
    out = defaultdict(list)
    for i, v in enumerate(label):
        out[v].append(i)
    return sorted(out.values())


@pytest.mark.parametrize("block", [100_000, 1_000])
def test_a_large_group_of_near_copies_is_not_repeated_for_its_keys(spark, monkeypatch, block):
    """Each node of a group is compared in few blocks, not once for each key it shares;
    components are those of brute force however small the blocks."""
    rows, written = {}, simhash.materialize

    def counted(df, label):
        out = written(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    texts = edited_copies(150)
    got = defaultdict(list)
    for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["component"]].append(r["doc_id"])
    assert sorted(map(sorted, got.values())) == components_of_texts(texts) and len(got) > 1
    blocks = 1 if 150 * 116 <= 2 * block else 2 + 150 * 116 // block
    assert rows["near-open"] <= blocks * len(texts)
    assert all(n <= blocks * len(texts) for label, n in rows.items() if label not in ("near-pairs", "near-links"))


def test_all_nodes_of_different_roots_meet_in_blocks(spark):
    """Group 1 is mostly of one root, 2 has as many roots as nodes, 3 is one block, 4 is done."""
    placed = [(1, i, 0 if i < 60 else i, 10) for i in range(80)] + [(2, i, i, 5) for i in range(100, 140)] + [(3, i, i, 1) for i in range(200, 205)] + [(4, i, 300, 9) for i in range(300, 340)]
    found = simhash.block_pairs(spark.createDataFrame(placed, "grp long, node long, root long, size long"), 50).collect()
    meet = defaultdict(list)
    for r in found:
        meet[r["key"]].append(r)
    got = {(min(x["node"], y["node"]), max(x["node"], y["node"])) for rows in meet.values() for x in rows if x["own"] for y in rows if x["root"] != y["root"]}
    assert got == {(a, b) for g, a, ra, _ in placed for h, b, rb, _ in placed if g == h and ra != rb and a < b}
    assert max(map(len, meet.values())) < 60 and not any(r["node"] >= 300 for r in found)
    common = Counter(r["node"] for r in found if r["node"] < 60)
    assert set(common.values()) == {4}  # the 20 others are 200 hashes, so 4 blocks
