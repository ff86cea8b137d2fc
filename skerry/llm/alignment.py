"""Alignment of two tokenizers' tokens by the bytes that they cover.

A byte-level BPE (side A) and a sentencepiece BPE (side B) encode the same text.  Byte
offsets where tokens of both sides end cut them into groups; every A token of a group
is linked with every B token of it.  The count of a pair of ids is the number of
documents that hold it linked; an A id's best partners are those of its highest count.

Method, a postings cogroup: tasks encode documents in batches and write, for each batch
and slot of A ids, the postings of the batch's documents: distinct pairs, how many
documents have each, these documents, and how often they hold the pair.  Pair counts
are sums of the batches' counts, combined before they are shuffled.  Counts and
postings then meet by slot in sorted streams, which Spark spills: a slot's counts come
first and give each A id's highest, then its postings pass one batch at a time and each
gives contributions to that batch's documents.  Contributions are summed by document in
a last shuffle by batch.

No slot is hot: its postings are dealt out by batch to so many salts that each has at
most about SALT_POSTINGS, and only its counts, which the vocabularies bound, are
repeated to them.  Contributions are as many for a document as there are slots,
whatever the size of the corpus.

Defined cases: a text that is null or empty, or whose joined token bytes of either side
differ from a space and the text (one with U+2581, which side B takes for a blank), has
no tokens: its numbers are zero and ``groups_sha256`` is ''.  Every row is a document
of its own: rows that repeat are returned and counted each; a null id stays null; ties
for the highest count are all best; an empty table gives an empty one; other columns
are ignored.  A text is aligned whole, in memory in proportion to it; a group of many
tokens is counted by its distinct ids, never as all of its links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, read_table, slices

SIDE_A, RANKS_A, SIDE_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Slots of A ids: an id's slot is its remainder.
SLOTS = 32
#: Postings that one salt of a slot holds, about.
SALT_POSTINGS = 8_000_000
#: Groups with more links than this are counted by their distinct ids.
LINKS_EACH = 4096
#: Bytes of text in a batch.
BATCH_BYTES = 2_000_000

#: Texts of these characters alone are split alike by every version of Unicode's classes.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-¬®-ÿŒœŠšŸŽž–—‘’“-„…€]*")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

STATS = "n_a", "n_b", "n_groups", "n_links"
RESULT = f"doc_id long, {', '.join(f'{c} long' for c in (*STATS, 'n_best', 'count_sum'))}, groups_sha256 string"
_POSTINGS = pa.schema([
    ("batch", pa.int64()), ("slot", pa.int32()), ("pairs", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
    ("docs", pa.binary()), ("times", pa.binary()),
    ("stats", pa.list_(pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in STATS), ("groups_sha256", pa.string())]))),
])
POSTINGS = (
    "batch long, slot int, pairs array<int>, sizes array<int>, docs binary, times binary, "
    f"stats array<struct<doc_id: long, {', '.join(f'{c}: long' for c in STATS)}, groups_sha256: string>>"
)


def _byte_characters() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, path_a: str, ranks_a: str | None, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        characters = _byte_characters()
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(characters[c] for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.width = len(self.bytes_b)
        if len(self.bytes_a) * self.width >= 1 << 31:
            raise ValueError("the vocabularies have more than 2^31 pairs")
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        #: ids as text with what follows them: the same side, the other side, the next group
        self.written_a, self.written_b = ([f"{i}{end}".encode() for end in ends for i in range(len(side))] for side, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        self.fast = self._ranks(ranks_a) if ranks_a else None

    def _ranks(self, path: str):
        """The same vocabulary in a faster library, if it is the same."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if any(self.bytes_a[i] != token for token, i in ranks.items()):
            raise ValueError("ranks and vocabulary of side A differ")
        return tiktoken.Encoding("side-a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides, or none where their bytes differ from the text's."""
        if not text:
            return [], []
        a, b = self.encode_a(" " + text), self.b.encode(text, num_threads=1)
        data = (" " + text).encode()
        whole = all(b"".join(map(side.__getitem__, ids)) == data for side, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if whole else ([], [])


@lru_cache(maxsize=1)
def sides(paths: tuple[str, str | None, str] | None = None) -> Sides:
    import public_tokenizers

    return Sides(*(paths or map(public_tokenizers.path, (SIDE_A, RANKS_A, SIDE_B))))


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, ..."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, times) of linked pairs, a key being document << 31 | pair; keys may repeat.
    ``n_a`` and ``n_b`` are the sizes of groups, ``doc`` the documents that they lie in."""
    first_b, links = np.cumsum(n_b) - n_b, n_a * n_b
    group = np.repeat(np.arange(len(n_a)), n_a)  # of each A token
    few = links[group] <= LINKS_EACH
    group, each = group[few], n_b[group[few]]
    partner = np.repeat(first_b[group], each) + _runs(each)
    keys = [np.repeat((doc[group] << 31) + a[few].astype(np.int64) * width, each) + b[partner]]
    times = [np.ones(len(keys[0]), np.int64)]
    first_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(links > LINKS_EACH):
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        keys.append(((doc[g] << 31) + ids_a.astype(np.int64)[:, None] * width + ids_b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
    return np.concatenate(keys), np.concatenate(times)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(times[order], starts) if len(starts) else times[:0]


def aligned(texts: list[str | None], s: Sides) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of each text its STATS and the digest of its groups; and (keys, times) of the pairs
    that the texts hold linked, a key being the text's place << 31 | pair."""
    coded = [s.encode(t) for t in texts]
    docs = np.arange(len(texts))
    count_a, count_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for c in coded for i in c[k]), np.int32, int(n.sum())) for k, n in ((0, count_a), (1, count_b)))
    ends_a, ends_b = np.cumsum(s.sizes_a[a]), np.cumsum(s.sizes_b[b])
    cut_a = np.isin(ends_a, ends_b, assume_unique=True, kind="sort") if len(a) else np.zeros(0, bool)
    cuts = ends_a[cut_a]
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    doc = np.repeat(docs, count_a)[cut_a]
    stats = np.stack([count_a, count_b, *(np.bincount(doc, w, len(texts)).astype(np.int64) for w in (None, n_a * n_b))])
    keys, times = _summed(*_links(a, b, n_a, n_b, s.width, doc))

    # tokens in the order in which they are written: each behind the tokens of the other side before it
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[np.cumsum(n_a) - 1] = last_b[np.cumsum(n_b) - 1] = True
    at_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(n_a)[group_b]
    written = np.empty(len(a) + len(b), object)
    written[at_a] = np.array(s.written_a, object)[a + last_a * len(s.bytes_a)] if len(a) else []
    written[at_b] = np.array(s.written_b, object)[b + last_b * len(s.bytes_b)] if len(b) else []
    digests, bounds = [], np.concatenate([[0], np.cumsum(count_a + count_b)]).tolist()
    for start, end in zip(bounds, bounds[1:], strict=False):
        digests.append(hashlib.sha256(b"".join(written[start:end].tolist())[:-1]).hexdigest() if end > start else "")
    return stats, digests, keys, times


def _packed(values: np.ndarray) -> bytes:
    """Small numbers in a byte each, others in eight."""
    return values.astype(np.uint8 if not len(values) or values.max() < 256 else "<i8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else "<i8").astype(np.int64)


def postings(docs: DataFrame, paths: tuple[str, str | None, str] | None = None) -> DataFrame:
    """For each batch of documents its postings by slot, and a row of slot -1 with what is
    known of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(paths)
        number = TaskContext.get().partitionId() << 32
        for rows in slices(batches, "text", BATCH_BYTES):
            stats, digests, keys, times = aligned(rows.column("text").to_pylist(), s)
            pairs, of = keys & 0x7FFFFFFF, keys >> 31
            slot = pairs // s.width % SLOTS
            order = np.lexsort((of, pairs, slot))
            pairs, of, times, slot = pairs[order], of[order], times[order], slot[order]
            out: list[list] = [[number], [-1], [None], [None], [None], [None]]
            out.append([[dict(zip(("doc_id", *STATS, "groups_sha256"), r, strict=True)) for r in zip(rows.column("doc_id").to_pylist(), *stats.tolist(), digests, strict=True)]])
            bounds = np.searchsorted(slot, np.arange(SLOTS + 1))
            for k in range(SLOTS):
                part = slice(bounds[k], bounds[k + 1])
                if bounds[k] == bounds[k + 1]:
                    continue
                starts = np.flatnonzero(np.diff(pairs[part], prepend=-1))
                sizes = np.diff(starts, append=bounds[k + 1] - bounds[k])
                row = [number, k, pairs[part][starts], sizes, of[part].astype("<u4" if len(digests) > 65536 else "<u2").tobytes(), _packed(times[part]), None]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _POSTINGS, strict=True)], schema=_POSTINGS)
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


def pair_counts(stored: DataFrame, width: int) -> DataFrame:
    """(slot, pair, n): the documents that hold a pair linked."""
    rows = stored.where("slot >= 0").select("slot", F.explode(F.arrays_zip("pairs", "sizes")).alias("p"))
    return rows.groupBy("slot", F.col("p.pairs").alias("pair")).agg(F.sum("p.sizes").alias("n"))


_GIVEN = pa.schema([("batch", pa.int64()), ("best", pa.binary()), ("sums", pa.binary())])
GIVEN = "batch long, best binary, sums binary"


class _Slot:
    """Counts of one slot's pairs, and whether each is its A id's highest."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, width: int) -> None:
        order = np.argsort(pairs)
        self.pairs, self.counts = pairs[order], counts[order]
        ids = self.pairs // width
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        highest = np.maximum.reduceat(self.counts, starts)
        self.best = self.counts == np.repeat(highest, np.diff(starts, append=len(ids)))

    def given(self, pairs: np.ndarray, sizes: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
        """What the postings of a batch give to each of its documents, to the last that has any."""
        at = np.repeat(np.searchsorted(self.pairs, pairs), sizes)
        n = int(docs.max()) + 1
        best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(best, docs, times * self.best[at])
        np.add.at(sums, docs, times * self.counts[at])
        return best.astype("<i4" if best.max() < 1 << 31 else "<i8").tobytes(), sums.tobytes()


def contributions(stored: DataFrame, counts: DataFrame, width: int, each: int = SALT_POSTINGS) -> DataFrame:
    """(batch, best, sums) of each batch and slot: links with a best partner, and sums of
    counts over links, by the document's place in the batch."""
    totals = {r["slot"]: r["n"] for r in counts.groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # SLOTS rows at most
    salts = {k: -(-n // each) for k, n in totals.items()}
    if not salts:
        return counts.sparkSession.createDataFrame([], GIVEN)
    of_slot = F.element_at(F.create_map(*(F.lit(x) for kv in salts.items() for x in kv)), F.col("slot"))
    first = counts.groupBy("slot", F.pmod(F.hash("pair"), F.lit(64)).alias("part")).agg(F.collect_list("pair").alias("pairs"), F.collect_list(F.col("n")).alias("counts"))
    first = first.select(
        "slot", F.explode(F.sequence(F.lit(0), of_slot.cast("int") - 1)).alias("salt"), F.lit(-1).cast("long").alias("batch"),
        "pairs", F.lit(None).cast("array<int>").alias("sizes"), "counts", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"),
    )
    then = stored.where("slot >= 0").select(
        "slot", F.pmod(F.xxhash64("batch"), of_slot).cast("int").alias("salt"), "batch", "pairs", "sizes", F.lit(None).cast("array<long>").alias("counts"), "docs", "times"
    )
    starts, tasks = {}, 0
    for k, n in salts.items():
        starts[k], tasks = tasks, tasks + n
    task = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("slot")) + F.col("salt")
    both = first.unionByName(then).withColumn("task", task).repartitionById(tasks, "task").sortWithinPartitions("task", "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, slot, pairs, numbers = None, None, [], []
        for batch in batches:
            names = batch.schema.names
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k] for i, c in enumerate(names)}
                here = row["task"].as_py()
                if here != place:
                    place, slot, pairs, numbers = here, None, [], []
                if row["batch"].as_py() < 0:
                    pairs.append(row["pairs"].values.to_numpy())
                    numbers.append(row["counts"].values.to_numpy())
                    continue
                slot = slot or _Slot(np.concatenate(pairs), np.concatenate(numbers), width)
                sizes = row["sizes"].values.to_numpy()
                total = int(sizes.sum())
                data = row["docs"].as_py()
                docs = np.frombuffer(data, "<u2" if len(data) == 2 * total else "<u4").astype(np.int64)
                best, sums = slot.given(row["pairs"].values.to_numpy(), sizes, docs, _unpacked(row["times"].as_py(), total))
                yield pa.record_batch([pa.array([row["batch"].as_py()], pa.int64()), pa.array([best], pa.binary()), pa.array([sums], pa.binary())], schema=_GIVEN)

    return both.mapInArrow(run, GIVEN)


def summed(stored: DataFrame, given: DataFrame) -> DataFrame:
    """A row of RESULT for each document: what is known of it, and its contributions added up."""
    tasks = partitions(stored)
    rows = stored.where("slot < 0").select("batch", "stats", F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("sums"))
    rows = rows.unionByName(given, allowMissingColumns=True).repartition(tasks, "batch").sortWithinPartitions("batch", F.col("stats").isNull())

    def finish(stats: pa.Array, best: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        names = ("doc_id", *STATS)
        columns = {n: stats.field(n) for n in (*names, "groups_sha256")} | {"n_best": pa.array(best), "count_sum": pa.array(sums)}
        order = (*names, "n_best", "count_sum", "groups_sha256")
        return pa.RecordBatch.from_arrays([columns[n] for n in order], list(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = best = sums = None
        for batch in batches:
            for known, b, s in zip(*(batch.column(c) for c in ("stats", "best", "sums")), strict=True):
                if known.is_valid:
                    if stats is not None:
                        yield finish(stats, best, sums)
                    stats = pa.concat_arrays([known.values])
                    best, sums = np.zeros(len(stats), np.int64), np.zeros(len(stats), np.int64)
                else:
                    more = np.frombuffer(s.as_py(), "<i8")
                    sums[: len(more)] += more
                    data = b.as_py()
                    best[: len(more)] += np.frombuffer(data, "<i4" if len(data) == 4 * len(more) else "<i8")
        if stats is not None:
            yield finish(stats, best, sums)

    return rows.mapInArrow(run, RESULT)


def alignment(docs: DataFrame, paths: tuple[str, str | None, str] | None = None, each: int = SALT_POSTINGS) -> DataFrame:
    """Rows of RESULT, one for each row of ``docs`` (doc_id, text)."""
    stored = materialize(postings(docs, paths), "postings")
    width = sides(paths).width
    counts = materialize(pair_counts(stored, width), "pair-counts")
    return summed(stored, contributions(stored, counts, width, each))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"))
