"""What each of five filters removes, alone and in every order of them.

Method, a fingerprint-routed RDD: texts go to partitions by their XXH64; a partition
keeps, by fingerprint, a chain of the different texts that have it, each whole and with
the smallest id seen, so that equal fingerprints are never taken for equal texts; ids
that are not the smallest come out as copies.  ``combineByKey`` then adds up, for each
part, how many documents fail which set of filters.  These 32 counts answer every order:
a filter removes, at its step, the documents whose set has it and none of the filters
before it.

A text that a third of all rows hold is met in two stages: a map task sends a text once,
with its smallest id, and tells the others as copies itself, so that a text crosses the
network once a task at most.

Defined cases: a null text is an empty one; a null part is the empty string; a row whose
id is null is no copy and makes none, and has no labels; rows that repeat an id and text
are counted each, and none is a copy of the other; a document has a label if any row of
``labels`` gives it; texts of any length are judged whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, read_table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 50, 65, 5
SYMBOLS = "#$%&*|"
#: Bytes of different texts that a map task holds before it sends them on.
HELD = 32_000_000

COUNTS = "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

#: Row of a document: id, part, set of failed filters, how many rows are alike in these.
Told = tuple[int | None, str, int, int]
_CAPITALS = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def failed(text: str) -> int:
    """The filters A to D that a text fails, as a set of bits."""
    words = text.encode().split()  # at the six ASCII blanks
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(_CAPITALS))) > MAX_CAPITALS_PERCENT * len(text)) << 2
        | any(s in text for s in SYMBOLS) << 3
    )


class Chains:
    """Different texts by fingerprint, each with the smallest id, the filters that it
    fails, and the parts of the rows that have this id and text."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, fingerprint: int, text: bytes, doc: int, mask: int, parts: Iterable[tuple[str, int]]) -> Iterator[Told]:
        """Enter rows of one id and text; rows now known to be copies come out."""
        chain = self.chains.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, doc, mask, Counter(dict(parts))])
            self.bytes += len(text)
        elif doc == entry[1]:
            entry[3].update(dict(parts))
        elif doc > entry[1]:
            yield from ((doc, part, mask | COPY, n) for part, n in parts)
        else:
            yield from ((entry[1], part, mask | COPY, n) for part, n in entry[3].items())
            entry[1], entry[3] = doc, Counter(dict(parts))

    def drain(self) -> Iterator[tuple[int, bytes, int, int, list[tuple[str, int]]]]:
        for fingerprint, chain in self.chains.items():
            for text, doc, mask, parts in chain:
                yield fingerprint, text, doc, mask, sorted(parts.items())
        self.__init__()


def _route(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """Texts keyed by fingerprint, as (text, id, mask, parts), and rows of which all is
    known, as (None, row), keyed by what spreads them."""
    held = Chains()
    for k, (doc, part, text) in enumerate(rows):
        mask = failed(text)
        if doc is None:
            yield k, (None, (doc, part, mask, 1))
            continue
        data = text.encode()
        fingerprint = xxhash.xxh64_intdigest(data)
        for told in held.add(fingerprint, data, doc, mask, ((part, 1),)):
            yield told[0] or 0, (None, told)
        if held.bytes > HELD:
            yield from ((f, tuple(rest)) for f, *rest in held.drain())
    yield from ((f, tuple(rest)) for f, *rest in held.drain())


def _settle(routed: Iterable[tuple[int, tuple]]) -> Iterator[Told]:
    """Rows of one partition, copies marked."""
    chains = Chains()
    for fingerprint, (text, *rest) in routed:
        if text is None:
            yield rest[0]
        else:
            yield from chains.add(fingerprint, text, *rest)
    for _, _, doc, mask, parts in chains.drain():
        yield from ((doc, part, mask, n) for part, n in parts)


def judged(docs: DataFrame, part: str = "source", tasks: int | None = None) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail the filters of ``mask``."""
    name = part.replace("`", "``")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    routed = rows.rdd.mapPartitions(_route).partitionBy(tasks or partitions(rows), int)
    told = routed.mapPartitions(_settle)
    return docs.sparkSession.createDataFrame(told, "doc_id long, part string, mask int, n long", verifySchema=False)


def vectors(told: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): for each part MASKS counts of rows, of good and of toxic ones."""
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic")
    )
    rows = told.join(label, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False)))

    def enter(counts: list[int], row: tuple) -> list[int]:
        mask, n, good, toxic = row
        counts[mask] += n
        counts[MASKS + mask] += n * good
        counts[2 * MASKS + mask] += n * toxic
        return counts

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    return rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: enter([0] * 3 * MASKS, row), enter, merge)


@lru_cache(maxsize=1)
def _steps() -> list[tuple[str, int, list[int], list[int], list[int], list[int]]]:
    """(order, step, and the masks that the step keeps, removes, finds removed before, and
    that fail its filter alone)."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            masks = range(MASKS)
            out.append((
                order, step, [m for m in masks if not m & (before | own)], [m for m in masks if m & own and not m & before],
                [m for m in masks if m & own and m & before], [own],
            ))
            before |= own
    return out


def orders(part: str, counts: list[int]) -> Iterator[tuple]:
    """Rows of SCHEMA of one part."""
    everyone, good, toxic = counts[:MASKS], counts[MASKS : 2 * MASKS], counts[2 * MASKS :]

    def total(of: list[int], masks: list[int]) -> int:
        return sum(map(of.__getitem__, masks))

    shapley = Counter()
    for order, step, _, removed, _, _ in _steps():
        shapley[order[step - 1]] += total(everyone, removed)
    for order, step, kept, removed, redundant, alone in _steps():
        yield (
            part, order, step, total(everyone, kept), total(everyone, removed), total(everyone, redundant), total(everyone, alone),
            total(good, removed), total(toxic, removed), shapley[order[step - 1]],
        )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows of SCHEMA: what each step of each order of the filters does in each part.  The
    parts' counts are written once and must add up to the rows of ``docs``."""
    spark = docs.sparkSession
    counts = materialize(spark.createDataFrame(vectors(judged(docs, part), labels), "part string, counts array<long>", verifySchema=False), "audit")
    told = counts.agg(F.sum(F.aggregate(F.slice("counts", 1, MASKS), F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    if told != (given := docs.count()):
        raise RuntimeError(f"{given} rows were given, {told} are accounted for")
    return spark.createDataFrame(counts.rdd.flatMap(lambda r: orders(*r)), SCHEMA, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: Every order is the text of its letters; a step's filters are the first letters of it.
OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS letter, CASE WHEN step = 1 THEN '' ELSE filter_order[1:step - 1] END AS before
  FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN translate(fails, before || letter, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS[:-1])},
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
