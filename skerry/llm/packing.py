"""Best-fit packing of token sequences by linear grouping.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.  What
the plan needs of them is a histogram of lengths, which has ``capacity`` entries
whatever the corpus; pieces as long as a sequence are sequences, under negative
numbers, and leave the plan out:

1. large lengths are split into groups of equal cardinality, and rounded up to
   the longest of their group;
2. configurations of these few sizes are chosen by column generation: a linear
   program whose columns come from an integer knapsack, rounded down, the rest
   by best-fit;
3. actual lengths take the places of the rounded ones, longest first;
4. small lengths go best-fit into the space that is left, then into new sequences.

The plan says, for every length, which ranks of its pieces go where.  Ranks are
given out without a task that sees all pieces of a length: pieces are dealt to
buckets of a bounded number of rows, and a bucket's first rank is a running sum
over bucket counts.

Defined cases: a null text is an empty document of one token (id 0); a null
``doc_id`` is packed like any other; repeated rows are packed each; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, materialize, read_table, slices

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Lengths from a share of the capacity on are large; the best of these shares is taken.
LARGE_SHARES = (0.5, 0.34, 0.2)
GROUPS = 24
#: Rows of a rank bucket, about.
BUCKET_ROWS = 500

#: Texts of these characters alone are lower-cased and split here; what Unicode
#: versions or normal forms could treat in another way goes to the tokenizer whole.
_PLAIN = re.compile("[\\t-\\r\\x20-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac]*")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u00ff"
_TOKENS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+")


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """The ids of a word-level BPE: a pre-token goes through the tokenizer's model
    once and is then remembered.  Texts with a special token's string, or with
    characters out of the plain set, go to the tokenizer whole."""

    REMEMBERED = 300_000
    #: characters of a pre-token that is remembered, at most: the bound is one of bytes, too
    LONGEST = 64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.characters = _byte_characters()

    def _word(self, word: str) -> bytes:
        written = word if word.isascii() else "".join(map(self.characters.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()
        if len(word) <= self.LONGEST:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, word = self.known, self._word
        return b"".join([known.get(w) or word(w) for w in _TOKENS.findall(text.lower())])


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer(path or public_tokenizers.path(VOCABULARY))


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for b in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = t.encode(text or "") + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                rows += [(doc_id, i, s, min(capacity, n - s), ids[4 * s:4 * (s + capacity)]) for i, s in enumerate(range(0, n, capacity))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids binary")


def grouped(sizes: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping: (rounded size, [(length, count)] longest first), groups of
    equal cardinality, largest first."""
    total = int(counts.sum())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    free = 0
    for size, n in sorted(zip(sizes.tolist(), counts.tolist(), strict=True), reverse=True):
        while n:
            if not free:
                out.append((size, []))
                free = each
            take = min(n, free)
            out[-1][1].append((size, take))
            n, free = n - take, free - take
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for size, members in out:  # groups that rounding made equal are one size
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(members)
        else:
            merged.append((size, members))
    return merged


def _knapsack(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """Best unbounded knapsack: its value and the number of each size."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    useful = np.flatnonzero(np.asarray(values) > 1e-12)
    useful = useful[np.argsort(np.array(sizes)[useful])]
    weight, worth = np.array(sizes)[useful], np.asarray(values)[useful]
    smallest = int(weight[0]) if len(weight) else capacity + 1
    fits = np.searchsorted(weight, np.arange(capacity + 1), side="right")
    for c in range(smallest, capacity + 1):
        k = fits[c]
        got = best[c - weight[:k]] + worth[:k]
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-12:
            best[c], last[c] = got[i], useful[i]
        else:
            best[c] = best[c - 1]
    column = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            column[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), column


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns of rounded sizes and how often each is used: the linear program by
    column generation with a basis of one column a size, rounded down."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = np.linalg.solve(basis, np.array(demand, float))
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        value, column = _knapsack(duals, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        d = np.linalg.solve(basis, column)
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        out = int(ratio.argmin())
        x = x - d * ratio[out]
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, i].astype(int), int(np.floor(x[i] + 1e-9))) for i in range(n) if x[i] >= 1 - 1e-9]


class Plan:
    """Sequences as (lengths in them, how many such sequences), and for every
    length which ranks go to which sequences and offsets."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.kinds: list[list] = []  # [space left, how many, [(length, times)]]

    def add(self, space: int, times: int, content: list[tuple[int, int]]) -> None:
        if times:
            self.kinds.append([space, times, content])

    @property
    def sequences(self) -> int:
        return sum(k[1] for k in self.kinds)

    def intervals(self) -> np.ndarray:
        """Rows (length, first rank, sequences, first sequence, offset): the ranks
        from the first on go round these sequences, and each round moves on by a length."""
        rank: dict[int, int] = {}
        rows, sequence = [], 0
        for _, times, content in self.kinds:
            offset = 0
            for length, k in content:
                rows.append((length, rank.get(length, 0), times, sequence, offset))
                rank[length] = rank.get(length, 0) + times * k
                offset += length * k
            sequence += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_shares: tuple[float, ...] = LARGE_SHARES) -> Plan:
    """The plan with the fewest sequences over the shares from which lengths are large."""
    return min((plan_for(histogram, capacity, groups, share) for share in large_shares), key=lambda p: p.sequences)


def plan_for(histogram: dict[int, int], capacity: int, groups: int, large_share: float) -> Plan:
    left = {k: int(v) for k, v in histogram.items() if v}
    out = Plan(capacity)
    if whole := left.pop(capacity, 0):
        out.add(0, whole, [(capacity, 1)])
    large = {k: v for k, v in left.items() if k >= large_share * capacity}
    spaces: list[list] = []  # [space, times, content], open sequences
    if large:
        sizes = np.array(list(large))
        grouping = grouped(sizes, np.array([large[s] for s in sizes.tolist()]), groups)
        rounded = [g[0] for g in grouping]
        supply = [sorted(g[1], reverse=True) for g in grouping]
        for pattern, times in configurations(rounded, [sum(n for _, n in s) for s in supply], capacity):
            # the actual documents of each group take its places, longest first
            slots = [i for i, k in enumerate(pattern) for _ in range(k)]
            while times and slots:
                run, content = times, []
                need: dict[int, int] = {}
                for i in slots:
                    need[i] = need.get(i, 0) + 1
                if any(sum(n for _, n in supply[i]) < k for i, k in need.items()):
                    break  # rounding may ask for more than there is
                for i, k in need.items():
                    run = min(run, max(1, supply[i][0][1] // k))
                for i, k in need.items():
                    want = k * run
                    if supply[i][0][1] >= want:
                        content.append((supply[i][0][0], k))
                        supply[i][0] = (supply[i][0][0], supply[i][0][1] - want)
                    else:  # run is 1: take what is there, length by length
                        while want:
                            length, n = supply[i][0]
                            take = min(n, want)
                            content.append((length, take))
                            want -= take
                            supply[i][0] = (length, n - take)
                            if n == take:
                                supply[i].pop(0)
                    if supply[i] and not supply[i][0][1]:
                        supply[i].pop(0)
                spaces.append([capacity - sum(a * b for a, b in content), run, content])
                times -= run
        rest = {}
        for s in supply:
            for length, n in s:
                rest[length] = rest.get(length, 0) + n
        for k in large:
            left.pop(k)
        for k, v in rest.items():
            if v:
                left[k] = v
    _best_fit(spaces, left, capacity)
    for space, times, content in spaces:
        out.add(space, times, content)
    return out


def _best_fit(spaces: list[list], left: dict[int, int], capacity: int) -> None:
    """Place lengths, longest first, each in the sequence with the least space
    that takes it; sequences alike are treated at once."""
    by_space: dict[int, list[list]] = {}
    for s in spaces:
        by_space.setdefault(s[0], []).append(s)
    spaces.clear()
    for length in sorted(left, reverse=True):
        n = left[length]
        for space in range(length, capacity + 1):
            while n and by_space.get(space):
                kind = by_space[space].pop()
                each = space // length  # best fit again and again: the same sequence is then the tightest
                full = min(kind[1], n // each)
                if full:
                    new = [space - each * length, full, [*kind[2], (length, each)]]
                    by_space.setdefault(new[0], []).append(new)
                    n -= full * each
                    kind[1] -= full
                if kind[1] and n:
                    k = min(n, each)
                    by_space.setdefault(space - k * length, []).append([space - k * length, 1, [*kind[2], (length, k)]])
                    n -= k
                    kind[1] -= 1
                if kind[1]:
                    by_space[space].append(kind)
            if not n:
                break
        if n:
            each = capacity // length
            if full := n // each:
                by_space.setdefault(capacity - each * length, []).append([capacity - each * length, full, [(length, each)]])
            if k := n % each:
                by_space.setdefault(capacity - k * length, []).append([capacity - k * length, 1, [(length, k)]])
    for kinds in by_space.values():
        spaces.extend(k for k in kinds if k[1])


def ranked(rows: DataFrame, histogram: dict[int, int], capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (materialised, with a ``uid``) and their ``rank``: 0, 1, ... within
    each length.  A length has as many buckets as its count asks for."""
    order = ["doc_id", "piece", "ids_crc32", "uid"]
    buckets = F.lit([-(-histogram.get(n, 0) // bucket_rows) or 1 for n in range(capacity + 1)])
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.element_at(buckets, F.col("length").cast("int") + 1)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("own")).drop("bucket", "own", "first")


def placed(rows: DataFrame, made: Plan) -> DataFrame:
    """``rows`` with sequence_id and offset for their length and rank.  The plan is
    bounded by the capacity, not by the corpus, and goes to the executors whole."""
    table = rows.sparkSession.sparkContext.broadcast(made.intervals())
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            lap, turn = np.divmod(rank - t[at, 1], t[at, 2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t[at, 3] + turn), pa.array(t[at, 4] + lap * length)], [*names, "sequence_id", "offset"])

    return arrow_map(rows, run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row a piece with its sequence and offset; ``keep_ids`` keeps the tokens.
    Ranks and places are given to rows without tokens, which join these at the end."""
    cut = pieces(docs, capacity, vocabulary).withColumn("ids_crc32", F.crc32("ids")).withColumn("uid", F.monotonically_increasing_id())
    cut = materialize(cut if keep_ids else cut.drop("ids"), "pieces")
    # a piece that fills a sequence is one, and needs neither rank nor shuffle
    zero = F.lit(0).cast("long")
    whole = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": zero})
    rest = cut.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = placed(ranked(rest.drop("ids"), histogram, capacity), plan(histogram, capacity)).drop("rank")
    rows = rows.join(rest.select("uid", "ids"), "uid") if keep_ids else rows
    return whole.unionByName(rows).drop("uid")


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from pieces that kept their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
