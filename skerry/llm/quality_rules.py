"""Quality rules: rule statistics of each document, and cross-document line frequency.

Method: hash each document's normalised lines, count the distinct documents of a
host (``source``) that hold a line, remove lines that more than a share of them
have, and reject documents that are depleted by it.

Defined cases: a null text has no words and fails the base rules; a null host is
a host of its own; lines without a word are never counted; rows that repeat a
document are returned each, and count once per distinct ``doc_id``; a document
whose ``doc_id`` is null counts as one of its own; texts of any length are judged whole.  Empty tables
give no rows.  Other columns are ignored by the statistics; ``cleaned`` keeps them, of any
name and type.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_map, fresh, materialize, read_table, slices, with_columns

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more than this share of one host's distinct documents is boilerplate,
LINE_PERCENT = 1
#: if more than so many have it.
LINE_FLOOR = 4
#: A document is depleted when fewer words, or a smaller share of them, remain.
MIN_LEFT_WORDS = 20
MIN_LEFT_SHARE = 0.2

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\r\x0b\x0c"

STATS = (
    "uid long, doc_id long, host string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<hash: long, words: long>>"
)
_STATS = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())])))]
)


def line_hash(line: str) -> int:
    """64-bit hash of a line's words with a space between them, A to Z lower-cased.  Blanks
    are the six of ASCII alone, as for words."""
    return xxhash.xxh64_intdigest(b" ".join(line.encode().lower().split())) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def document_stats(text: str | None) -> tuple[int, int, int, int, int, dict[int, int]]:
    text = text or ""
    words = text.encode().split()
    blanks = sum(text.count(c) for c in BLANK)
    lines: dict[int, int] = {}
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if n := len(line.encode().split()):
            if line in seen:
                dup += 1
            seen.add(line)
            h = line_hash(line)
            lines[h] = lines.get(h, 0) + n
    return len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), lines


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    for batch in slices(batches, "text"):
        out: list[list] = [[] for _ in _STATS]
        for doc_id, host, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "text")), strict=True):
            *numbers, lines = document_stats(text)
            row = [uid, doc_id, host, *numbers, [{"hash": h, "words": n} for h, n in lines.items()]]
            uid += 1
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _STATS, strict=True)], schema=_STATS)


def statistics(docs: DataFrame) -> DataFrame:
    """One row a document with the rule statistics and its distinct line hashes."""
    return arrow_map(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), _stats, STATS)


def frequent_lines(stats: DataFrame, line_limit: int | None = None) -> DataFrame:
    """(host, hash, n_docs) of the lines that more than LINE_PERCENT of one host's
    distinct documents have, and more than LINE_FLOOR; or, where ``line_limit`` is
    given, more than so many of them."""
    counts = _lines(stats).groupBy("host", "hash").agg(F.count_distinct("doc").alias("n_docs"))
    if line_limit is not None:
        return counts.where(F.col("n_docs") > line_limit)
    hosts = stats.select(_host().alias("host"), _doc().alias("doc")).groupBy("host").agg(F.count_distinct("doc").alias("of"))
    often = counts.where(F.col("n_docs") > LINE_FLOOR).join(hosts, "host")
    return often.where(100 * F.col("n_docs") > LINE_PERCENT * F.col("of")).drop("of")


def _lines(stats: DataFrame) -> DataFrame:
    return stats.select("uid", "doc_id", _host().alias("host"), _doc().alias("doc"), F.inline("lines"))


def _host() -> Column:
    return F.coalesce("host", F.lit(""))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id"), -F.col("uid") - 1)


def judge(stats: DataFrame, line_limit: int | None = None, min_left_words: int = MIN_LEFT_WORDS, min_left_share: float = MIN_LEFT_SHARE) -> DataFrame:
    """``stats`` (materialised) with base_failed, n_left_words, n_removed_lines and kept."""
    removed = (
        _lines(stats)
        .join(frequent_lines(stats, line_limit).select("host", "hash"), ["host", "hash"])
        .groupBy("uid")
        .agg(F.sum("words").alias("removed"), F.count("*").alias("n_removed_lines"))
    )
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        stats.join(removed, "uid", "left")
        .withColumn("n_left_words", left)
        .withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= min_left_words) & (left >= min_left_share * F.col("n_words")))
        .drop("removed")
    )


def cleaned(docs: DataFrame, line_limit: int | None = None) -> DataFrame:
    """The documents without their frequent lines, in a column ``clean_text``, which
    replaces one of that name in any case; a document without an id keeps its lines."""
    stats = materialize(statistics(docs), "quality")
    host, own, gone_ = fresh(docs, "host", "own", "gone")
    often = (
        _lines(stats).where("doc_id IS NOT NULL").join(frequent_lines(stats, line_limit), ["host", "hash"])
        .groupBy(F.col("host").alias(host), F.col("doc").alias(own)).agg(F.collect_set("hash").alias(gone_))
    )
    hosted = docs.withColumns({host: F.coalesce(F.col("source").cast("string"), F.lit("")), own: F.col("doc_id").cast("long")})
    joined = hosted.join(often, [host, own], "left").drop(host, own)

    def strip(texts: pa.Array, gone: pa.Array) -> list[pa.Array]:
        out = []
        for text, lines in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            lines = set(lines or ())
            out.append(text if text is None or not lines else "\n".join(x for x in text.split("\n") if not x.encode().split() or line_hash(x) not in lines))
        return [pa.array(out, pa.string())]

    return with_columns(joined, StructType([StructField("clean_text", StringType())]), ["text", gone_], strip).drop(gone_)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics(read_table(spark, sf_dir, "documents")), "quality")
    return judge(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words", "n_removed_lines"
    )
