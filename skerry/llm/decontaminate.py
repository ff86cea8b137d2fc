"""Benchmark decontamination by a distributed positional inverted index.

Method: every benchmark window keeps its two rarest terms, by their counts over
the whole corpus; postings (term, doc, position) of those terms alone are stored;
lists are shifted by the terms' offsets in the window and intersected; what is
left is compared word by word.  Only DataFrame functions are used.

An exact phrase match is a window whose words stand in the document as they are.  A
proximity match is a window that has none there, whose two rarest terms stand at most
``SLOP`` words out of their distance, and of whose distinct words ``NEAR_PERCENT`` or
more stand in the stretch around, ``SLOP`` words to either side of it.  Only exact
matches make a document contaminated.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
A window is 10 consecutive words of an item; an item with fewer words, but not
none, is one window.

Defined cases: null texts have no words; items without words match nothing; an
item whose id is null counts for hits but is not listed; repeated items are one;
rows of one ``doc_id`` are judged each by its own text; empty tables work; columns
of any other name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from .common import columns, fresh, materialize, read_table

WINDOW = 10
RAREST = 2
SLOP = 3
NEAR_PERCENT = 80
#: Tables of terms and windows up to so many rows and bytes, as counted, are broadcast;
#: larger ones join by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none of a null.  Split at what lies between them: to
    extract matches copies the whole text for each."""
    plain = F.octet_length(text) == F.length(text)  # ASCII alone: lower() is the same and faster
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BETWEEN, -1), "")


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES
    bytes of text and of fields, else as it is."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, ArrayType):
            size = size + F.coalesce(F.aggregate(f.name, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0))
        elif isinstance(f.dataType, StringType):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
    told = df.agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes")).first()
    return F.broadcast(df) if told["rows"] <= BROADCAST_ROWS and (told["bytes"] or 0) <= BROADCAST_BYTES else df


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window_id, w) of the distinct windows, and (window_id, item_id)."""
    w = F.col("w")
    count = F.size(w)
    cut = F.when(count >= window, F.transform(F.sequence(F.lit(1), count - window + 1), lambda i: F.slice(w, i, window))).otherwise(F.array(w))
    pairs = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(count > 0)
    pairs = pairs.select("item_id", F.explode(cut).alias("w")).distinct().withColumn("window_id", F.sha2(F.array_join("w", " "), 256))
    pairs = materialize(pairs, "windows")
    return pairs.select("window_id", "w").dropDuplicates(["window_id"]), pairs.select("window_id", "item_id")


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n): how often each term of a window occurs in the corpus; those that do."""
    vocabulary = materialize(windows.select(F.explode("w").alias("term")).distinct(), "vocabulary")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return tokens.join(small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(term, window_id, offset, terms): the rarest terms of each window that can
    occur, each with its first place there, and how many were taken."""
    placed = windows.select("window_id", "w", F.posexplode("w").alias("offset", "term")).groupBy("window_id", "term").agg(F.min("offset").alias("offset"), F.first(F.size("w")).alias("size"))
    known = placed.join(counts, "term", "left")
    taken = known.groupBy("window_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))), 1, rarest).alias("t")
    )
    possible = taken.where(F.col("t")[0]["n"] > 0)
    return possible.select("window_id", F.size("t").alias("terms"), F.array_min(F.transform("t", lambda x: x["offset"])).alias("lead"), F.inline("t")).drop("n")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, pos) of the given distinct terms: the positional index."""
    tokens = docs.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return tokens.join(small(terms), "term")


def intersect(index: DataFrame, chosen: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc, window_id, start, near): places where the chosen terms of a window stand
    at their offsets, and, with ``near`` above 0, where the later of two terms stands
    that many words out of its distance to the one before, at most ``slop``."""
    shifted = index.join(small(chosen), "term").select("doc", "window_id", "terms", "offset", "lead", (F.col("pos") - F.col("offset")).alias("start"))
    upto = Window.partitionBy("doc", "window_id").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_lead = F.col("offset") == F.col("lead")
    before = F.when(is_lead, F.max(F.when(~is_lead, F.col("start"))).over(upto)).otherwise(F.max(F.when(is_lead, F.col("start"))).over(upto))
    near = F.when(F.col("terms") == 1, 0).otherwise(F.col("start") - before)
    found = shifted.withColumn("near", near.cast("int")).where(F.col("near") <= slop)
    return found.where("start >= 0 OR near > 0").groupBy("doc", "window_id", "start").agg(F.min("near").alias("near"))


def covered(hits: Column) -> Column:
    """Words covered by an array of (start, size), overlaps counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, h: Column) -> Column:
        end = (h["start"] + h["size"]).cast("long")
        fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], h["start"].cast("long")))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + fresh).alias("total"))

    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["total"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` with n_words, n_hit, hits and near, under names that are given third:
    hits is an array of (start, size, window_id), near one of the window_ids of proximity
    matches.  And the table (window_id, item_id)."""
    doc, candidates, word, n_words, n_hit, hit, near = names = fresh(docs, "doc", "candidates", "words", "n_words", "n_hit", "hits", "near")
    windows, owners = benchmark_windows(items, window)
    chosen = materialize(rarest_terms(windows, term_counts(docs, windows), rarest), "terms")
    index = materialize(postings(docs, chosen.select("term").distinct()), "postings")
    found = intersect(index, chosen)
    found = found.join(small(windows), "window_id")
    by_doc = found.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("start", "near", "window_id", "w")).alias(candidates))
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))).join(by_doc, doc, "left").withColumn(word, words(F.col("text")))

    def is_exact(c: Column) -> Column:
        return (c["near"] == 0) & (c["start"] >= 0) & (F.slice(word, F.greatest(c["start"], F.lit(0)) + 1, F.size(c["w"])) == c["w"])

    def is_near(c: Column) -> Column:
        first = F.greatest(c["start"] + 1 - SLOP, F.lit(1))
        stretch = F.slice(word, first, c["start"] + 1 + F.size(c["w"]) + SLOP - first)
        return 100 * F.size(F.array_intersect(c["w"], stretch)) >= NEAR_PERCENT * F.size(F.array_distinct(c["w"]))

    none = F.array().cast("array<struct<start: int, size: int, window_id: string>>")
    exact = F.transform(F.filter(candidates, is_exact), lambda c: F.struct(c["start"].cast("int").alias("start"), F.size(c["w"]).alias("size"), c["window_id"].alias("window_id")))
    others = F.array_distinct(F.transform(F.filter(candidates, is_near), lambda c: c["window_id"]))
    rows = rows.withColumn(hit, F.coalesce(exact, none)).withColumn(near, F.array_except(F.coalesce(others, F.array().cast("array<string>")), F.transform(hit, lambda h: h["window_id"])))
    rows = rows.withColumn(n_words, F.size(word).cast("long")).withColumn(n_hit, covered(F.col(hit))).drop(doc, candidates, word)
    return rows, owners, names[3:]


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    judged, owners, _ = contamination(docs.select("doc_id", "text"), items, window, rarest)
    rows = materialize(judged.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_words", "n_hit", F.array_distinct(F.transform("hits", lambda h: h["window_id"])).alias("found"), F.size("near").cast("long").alias("n_near")), "contamination")
    listed = (
        rows.select("uid", F.explode("found").alias("window_id")).join(small(owners), "window_id")
        .groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    none = F.array().cast("array<string>")
    items_of = F.coalesce(F.col("items"), none)
    return rows.join(listed, "uid", "left").select(
        "doc_id", "n_words", "n_hit", F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, with the columns of ``docs``."""
    judged, _, (_, n_hit, *_) = contamination(docs, items, window)
    return judged.where(F.col(n_hit) == 0).select(*columns(docs.columns))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS t
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s
  FROM d CROSS JOIN (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (
  SELECT p.doc_id, p.s, p.size, p.t, win.item_id
  FROM (SELECT doc_id, s, size, array_to_string(w[s + 1 : s + size], ' ') AS t FROM pos) p JOIN win USING (t, size)),
per AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY doc_id),
cov AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
one AS (
  SELECT DISTINCT w[s + 1 : s + least(len(w), 10)] AS v, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS t
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
token AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
n AS (SELECT term, count(*) AS n FROM token GROUP BY term),
place AS (SELECT t, term, min(o) AS o FROM (SELECT t, unnest(v) AS term, unnest(range(0, len(v))) AS o FROM one) GROUP BY t, term),
rare AS (
  SELECT t, term, o, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), o, term) AS k FROM place LEFT JOIN n USING (term)),
two AS (SELECT t, term, o, count(*) OVER (PARTITION BY t) AS terms FROM rare WHERE k <= 2 AND t NOT IN (SELECT t FROM rare WHERE k = 1 AND n = 0)),
post AS (SELECT doc_id, t, term, pos - o AS s FROM token JOIN two USING (term) WHERE terms = 2),
near AS (
  SELECT DISTINCT b.doc_id, b.t, b.s FROM post a JOIN post b ON a.doc_id = b.doc_id AND a.t = b.t AND a.term <> b.term AND b.s - a.s BETWEEN 0 AND 3),
nearby AS (
  SELECT DISTINCT near.doc_id, near.t FROM near JOIN one USING (t) JOIN d USING (doc_id)
  WHERE 100 * len(list_intersect(v, w[greatest(s - 2, 1) : s + len(v) + 3])) >= 80 * len(list_distinct(v))),
close AS (
  SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, t FROM nearby EXCEPT SELECT doc_id, t FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(per.n_items, 0) AS n_items,
  sha256(coalesce(per.ids, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated, coalesce(close.n_near, 0) AS n_near
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN close USING (doc_id)
"""
