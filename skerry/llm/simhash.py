"""SimHash near-dedup: 64-bit fingerprints, linked at a Hamming distance of at most 4.

Method: binary trie self-join.  Distinct fingerprints are put into sorted arrays,
in which a trie's node is a range; pairs of nodes are followed together from the
root, differing bits add up, and a pair is pruned when the budget is exceeded.
For distribution the 64 bits are cut into blocks: of ``m`` blocks at least
``m - 4`` agree in every linked pair, so each choice of that many blocks is a key
whose bucket gets a trie of its own; no link is lost.  A bucket gives a spanning
forest of its links instead of the links themselves: budgets 1, 2 and 4 run in
turn, and pairs of nodes that are connected by then are pruned, so that a large
group of close copies costs no square of its size.

Defined cases: a text without words (null, empty, blanks) has fingerprint zero and
links like any other; repeated rows are returned each; a null ``doc_id`` is
returned and never names a component with other ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fresh, materialize, read_table, slices, whole_groups
from .components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: A bucket of a block key is planned to hold about this many fingerprints.
BUCKET = 2000
#: Node pairs followed at once; bounds a task's memory.
FRONTIER = 400_000

#: Near copies of ``deduplicated``: runs of five words with a Jaccard similarity of
#: 0.8 or more.  Of SIGNATURE bits the first 64 * NEAR_WORDS are the fingerprint that
#: tries compare, and keys are chosen from all of them.
NEAR_SHINGLE = 5
SIGNATURE, NEAR_WORDS, NEAR_DISTANCE = 1024, 3, 56
#: A key's bucket is planned to hold no more than this many fingerprints.
NEAR_BUCKET = 64
#: A pair at 0.8 differs in this share of its bits, and at most in the second one where a
#: set has FEW members or less; it shares no key with the probability MISSED.
DIFFER, DIFFER_FEW, FEW, MISSED = 0.16, 0.19, 10, 0.0005
#: Linked sets are compared in blocks of about this many hashes; a task holds two.
BLOCK = 100_000
#: Pairs that one task makes a spanning forest of.
FOREST = 1_000_000
_RANDOM = np.random.default_rng(SEED)
_TURNS = _RANDOM.integers(0, 1 << 63, SIGNATURE // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text, by the definition; tests compare with it."""
    hashes = np.array(shingle_hashes((text or "").encode(), size), np.uint64)
    return int(_majority(hashes, np.array([0]), np.array([len(hashes)]))[0])


def shingle_hashes(data: bytes, size: int = SHINGLE) -> list[int]:
    words = data.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    h = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: -size])]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:], strict=True)]


def _majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int64)
    set_bits = (2 * ones > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2_000_000):
        hashes: list[int] = []
        counts = []
        for data in b.column("text").cast(pa.binary()).to_pylist():
            h = shingle_hashes(data or b"")
            counts.append(len(h))
            hashes += h
        counts = np.array(counts, np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        fp = _majority(np.array(hashes, np.uint64), starts, counts).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a signed long with the fingerprint's bits."""
    return arrow_map(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


def _label(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Component labels after joining u[i] and v[i]: the smallest index."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of one key.

    keys, fps: a row each, fps distinct within a key.  Returns two arrays of
    fingerprints, linked pairwise or by way of others of the same forest."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    label = _trie_labels(keys, [fps], distance)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def trie_groups(keys: np.ndarray, words: list[np.ndarray], distance: int) -> np.ndarray:
    """For each row one row of its key that its fingerprint reaches by links, the same for
    all that reach one another.  words: the words of the fingerprints, which may repeat."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.lexsort((*reversed(words), keys))
    keys, words = keys[order], [w[order] for w in words]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in (keys, *words)], axis=0)])
    first = np.flatnonzero(new)
    label = first[_trie_labels(keys[first], [w[first] for w in words], distance)]
    out = np.empty(len(keys), np.int64)
    out[order] = order[label[np.cumsum(new) - 1]]
    return out


def _trie_labels(keys: np.ndarray, words: list[np.ndarray], distance: int) -> np.ndarray:
    """Labels of the components of sorted, distinct fingerprints of one key."""
    n, bits = len(keys), 64 * len(words)
    if n < 2:
        return np.arange(n)
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    root_lo, root_hi = cut, np.concatenate([cut[1:], [n]])
    keep = root_hi - root_lo > 1
    root_lo, root_hi = root_lo[keep], root_hi[keep]
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((words[depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1), dtype=np.int32)])
        c = ones[depth]
        return hi - (c[hi] - c[lo])

    for budget in sorted({min(1, distance), min(2, distance), distance}):
        todo = [(root_lo, root_hi, root_lo, root_hi, np.zeros(len(root_lo), np.int8), 0)]
        change = np.cumsum(np.concatenate([[0], (label[1:] != label[:-1])]))
        while todo:
            alo, ahi, blo, bhi, diff, depth = todo.pop()
            if len(alo) > FRONTIER:
                half = len(alo) // 2
                todo += [(alo[s], ahi[s], blo[s], bhi[s], diff[s], depth) for s in (slice(half, None), slice(half))]
                continue
            # pairs of nodes that one component covers need no more links
            known = (label[alo] == label[blo]) & (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo])
            single = (ahi - alo == 1) & (bhi - blo == 1) & (alo != blo)
            if single.any():
                u, v = alo[single & ~known], blo[single & ~known]
                near = sum(np.bitwise_count(w[u] ^ w[v]) for w in words) <= budget
                if near.any():
                    label = _label(n, u[near], v[near], label)
                    change = np.cumsum(np.concatenate([[0], (label[1:] != label[:-1])]))
            go = ~known & ~single
            if not go.any() or depth == bits:
                continue
            alo, ahi, blo, bhi, diff = alo[go], ahi[go], blo[go], bhi[go], diff[go]
            am, bm = split(alo, ahi, depth), split(blo, bhi, depth)
            own = alo == blo
            nxt = []
            for x0, x1, y0, y1, add, skip in ((alo, am, blo, bm, 0, False), (am, ahi, bm, bhi, 0, False), (alo, am, bm, bhi, 1, False), (am, ahi, blo, bm, 1, True)):
                ok = (x1 > x0) & (y1 > y0) & (diff + add <= budget)
                if skip:
                    ok &= ~own
                ok &= ~((x0 == y0) & (x1 - x0 == 1))
                nxt.append((x0[ok], x1[ok], y0[ok], y1[ok], (diff[ok] + add).astype(np.int8)))
            joined = tuple(np.concatenate(c) for c in zip(*nxt, strict=True))
            if len(joined[0]):
                todo.append((*joined, depth + 1))
    return label


def _blocks(m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of m blocks that cover 64 bits."""
    edges = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_keys(n: int, distance: int = DISTANCE, bucket: int = BUCKET) -> list[list[tuple[int, int]]]:
    """The choices of blocks that are keys for n fingerprints: the fewest blocks
    that leave about ``bucket`` fingerprints to a key's value."""
    for m in range(distance + 1, 2 * distance + 2):
        choices = [list(c) for c in combinations(_blocks(m), m - distance)]
        if n >> min(sum(w for _, w in c) for c in choices) <= bucket:
            break
    return choices


def links(distinct: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): fingerprints linked within ``distance``; spanning forests of all links."""
    keys = []
    for i, choice in enumerate(block_keys(n, distance)):
        key = F.lit(i).cast("long")
        for low, width in choice:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(keys) // 300_000 + 1)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            a, b = trie_links(t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return arrow_map(rows.repartition(parts, "key").sortWithinPartitions("key"), join, "a long, b long")


def components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id), a row a document."""
    prints = materialize(fingerprints(docs), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), distinct.count(), distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(first, "root").select("fp", "component_id")
    return prints.join(labels, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's runs of NEAR_SHINGLE words, sorted."""
    for data in texts:
        yield np.unique(np.array(shingle_hashes(data or b"", NEAR_SHINGLE), np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    """The SIGNATURE bits of a set, as bytes: each is 1 if set in over half of its hashes."""
    ones = np.zeros(SIGNATURE, np.int64)
    for i in range(0, len(found), 255):  # as many as a byte can count
        h = found[i : i + 255, None] * _TURNS
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found))


def key_tables(n: int) -> tuple[np.ndarray, int]:
    """The choices of bits that are keys for n signatures, a row each, and how many of
    them, the first ones, are enough for sets of more than FEW members."""
    width = min(max(1, (n // NEAR_BUCKET).bit_length()), 32)
    enough, few = (math.ceil(math.log(MISSED) / math.log1p(-((1 - share) ** width))) for share in (DIFFER, DIFFER_FEW))
    draw = np.random.default_rng([SEED, width])
    return np.array([draw.choice(SIGNATURE, width, replace=False) for _ in range(few)]), enough


def _near_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2_000_000):
        nodes, signs, sizes = [], [], []
        for found in near_sets(b.column("text").cast(pa.binary()).to_pylist()):
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            signs.append(signature(found).tobytes())
            sizes.append(len(found))
        node = pa.array(np.array(nodes, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("digest"), node, pa.array(signs, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "digest", "node", "sign", "size"])


def near_groups(nodes: DataFrame, n: int, distance: int = NEAR_DISTANCE) -> DataFrame:
    """(node, key, least) of those of n nodes (node, sign, size) that are linked to another
    one: a group's nodes share a choice of bits, and a trie of these links them.  least: the
    group's smallest node."""
    tables, enough = key_tables(n)
    names = [f"w{i}" for i in range(NEAR_WORDS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.int64(1) << np.arange(tables.shape[1])
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                signs = np.frombuffer(b"".join(b.column("sign").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(signs, axis=1)
                keys = np.stack([bits[:, t] @ places + (i << 32) for i, t in enumerate(tables)], axis=1)
                rows, table = np.nonzero((b.column("size").to_numpy() <= FEW)[:, None] | (np.arange(len(tables)) < enough))
                words = np.ascontiguousarray(signs[:, : 8 * NEAR_WORDS]).view(np.int64)[rows]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (keys[rows, table], b.column("node").to_numpy()[rows], *words.T))], ["key", "node", *names])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            label = trie_groups(key, [t.column(w).to_numpy().view(np.uint64) for w in names], distance)
            many = np.bincount(label, minlength=len(label))[label] > 1
            least = node.copy()
            np.minimum.at(least, label, node)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (node[many], key[many], node[label[many]], least[label[many]]))], ["node", "key", "root", "least"])

    kind = ", ".join(f"{c} long" for c in ("key", "node", *names))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * enough // 300_000 + 1)
    rows = arrow_map(nodes.select("node", "sign", "size"), deal, kind).repartition(parts, "key").sortWithinPartitions("key")
    return arrow_map(rows, join, "node long, key long, root long, least long").select("node", F.xxhash64("key", "root").alias("key"), "least")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2_000_000):
        found = [x.view(np.int64) for x in near_sets(b.column("text").cast(pa.binary()).to_pylist())]
        sizes = pa.array([len(x) for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("node"), sizes, pa.array(found, pa.list_(pa.int64()))], ["node", "size", "found"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a partition's pairs (a, b)."""
    whole = [b for b in batches if b.num_rows]
    if whole:
        t = pa.Table.from_batches(whole)
        nodes, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        label = _label(len(nodes), at[: t.num_rows], at[t.num_rows :], np.arange(len(nodes)))
        far = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[far]]), pa.array(nodes[far])], ["a", "b"])


def block_pairs(placed: DataFrame, block: int) -> DataFrame:
    """(node, root, key, own): keys of pairs of blocks in which all nodes of a group meet that
    have different roots.  placed: (grp, node, root, size).

    A group's commonest root has blocks of its own, which meet the others and not one
    another; own is false in the second block of two, whose nodes meet elsewhere."""
    roots = placed.groupBy("grp", "root").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    most = F.max(F.struct("n", "root", "held")).alias("most")
    groups = roots.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), most).where("n > 2 AND most.n < n")
    whole = F.col("held") <= 2 * block
    others = F.when(whole, 1).otherwise(F.ceil((F.col("held") - F.col("most.held")) / block)).cast("int")
    common = F.when(whole, 0).otherwise(F.ceil(F.col("most.held") / block)).cast("int")
    groups = groups.select("grp", F.when(~whole, F.col("most.root")).alias("common_root"), others.alias("others"), common.alias("common"))
    is_common = F.coalesce(F.col("root") == F.col("common_root"), F.lit(False))
    rows = placed.join(groups, "grp").withColumn("is_common", is_common)
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = F.when(F.col("is_common"), F.col("others") + spread("common")).otherwise(spread("others"))
    meets = F.when(F.col("is_common"), F.col("others")).otherwise(F.col("others") + F.col("common"))
    rows = rows.withColumn("at", own).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    return rows.select("node", "root", F.xxhash64("grp", F.least("at", "other"), F.greatest("at", "other")).alias("key"), (F.col("at") <= F.col("other")).alias("own"))


def similar(both: int, a: int, b: int) -> bool:
    """Whether sets of ``a`` and ``b`` members, ``both`` of them shared, have a Jaccard similarity of 0.8 or more."""
    return 5 * both >= 4 * (a + b - both)


def bucket_links(sets: list[np.ndarray], label: np.ndarray, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between similar sets whose labels differ, enough of them to connect
    all that similar pairs connect; pairs that are connected are not compared, nor are
    those of two sets that are not ``own``, if given."""
    n, label, out = len(sets), label.copy(), []
    sizes = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(n), sizes)[order]
    for i in range(n) if own is None else np.flatnonzero(own).tolist():
        if (label == label[i]).all():
            continue
        lo, hi = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
        count = np.zeros(n, np.int64)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            count[owner[a:b]] += 1
        for j in np.flatnonzero((label != label[i]) & (5 * count >= 4 * (sizes + sizes[i] - count))).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "key"):
        key, node, root, own = (t.column(c).to_numpy() for c in ("key", "node", "root", "own"))
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        a, b = [], []
        for lo, hi in zip(cut, cut[1:], strict=False):
            sets = [np.array(x, np.int64) for x in t.column("found").slice(lo, hi - lo).to_pylist()]
            for i, j in bucket_links(sets, np.unique(root[lo:hi], return_inverse=True)[1], own[lo:hi]):
                a.append(node[lo + i])
                b.append(node[lo + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, component), a row a document: connected by a Jaccard
    similarity of NEAR_SHINGLE-word shingles of 0.8 or more.

    Texts of one set are one node.  Nodes of a group of ``near_groups`` are compared with
    its smallest.  What the groups connect is then one group, in which each node is once,
    however many keys it had; where the comparisons left it in several components, nodes of
    different ones are compared, in blocks."""
    digested = docs.select("doc_id", _digest().alias("digest"), "text")
    prints = materialize(arrow_map(digested, _near_prints, "doc_id long, digest binary, node long, sign binary, size long"), "near")
    nodes = prints.where("size > 0").groupBy("node").agg(F.min("digest").alias("digest"), F.first("sign").alias("sign"), F.first("size").alias("size"))
    pairs = near_groups(nodes, prints.count()).where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialize(pairs, "near-pairs")
    forest = arrow_map(pairs.repartition(pairs.count() // FOREST + 1), _forest, "a long, b long")
    groups = materialize(connected_components(forest).select("node", F.col("root").alias("grp")), "near-groups")
    involved = nodes.select("node", "digest").join(groups.select("node"), "node")
    sets = digested.join(involved, "digest").select("node", "text").dropDuplicates(["node"])
    sets = materialize(arrow_map(sets, _sets, "node long, size long, found array<long>"), "near-sets")
    compared = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    links = materialize(compared.where(similar(both, F.size("x"), F.size("y"))).select("a", "b"), "near-links")
    roots = connected_components(links)
    placed = groups.join(roots, "node", "left").join(sets.select("node", "size"), "node").select("grp", "node", F.coalesce("root", "node").alias("root"), "size")
    still = materialize(block_pairs(materialize(placed, "near-placed"), BLOCK), "near-open")
    if n := still.count():
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1_000 + 1)
        more = arrow_map(still.join(sets.select("node", "found"), "node").repartition(parts, "key").sortWithinPartitions("key"), _bucket_links, "a long, b long")
        roots = connected_components(links.unionByName(more))
    return prints.join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("component"))


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, one of each component of ``near_components``: the one with
    the smallest id.  Of rows that repeat its id and text one is returned; other
    texts of the same id are judged as documents of their own.  Where the id is
    null nothing is dropped."""
    named = near_components(docs).where("doc_id IS NOT NULL")
    (digest,) = fresh(docs, "digest")
    keep = named.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("k")).select("k.doc_id", F.col("k.digest").alias(digest))
    own = docs.withColumn(digest, _digest())
    kept = own.join(keep, ["doc_id", digest], "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)
    return kept.unionByName(docs.where("doc_id IS NULL"))
