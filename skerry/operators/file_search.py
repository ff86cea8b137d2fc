"""Ranked search over a file tree: names and content, scored by one term query."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import FileQ, coerce_file_query, format_file_query
from ..sources import extract, media
from ..sources.cache import UnitCache
from ..sources.files import WalkOptions, list_files
from . import matchers, units
from .layout import few_or_once

# The shortest query that pictures are compared with, and a picture's line.
LEAST_PICTURE_QUERY, VISUAL = 4, "(visual match)"
PICTURES_AT_ONCE = 16

LINE = "struct<line_number: int, text: string, score: double, location_kind: string, matched_term: string>"
RESULTS = f"path string, score double, breakdown map<string, double>, lines array<{LINE}>, term_surfaces map<string, map<string, double>>"
SKIPPED = "path string, size_bytes long, reason string"


@dataclass(frozen=True)
class FileSearch:
    results: DataFrame
    skipped: DataFrame


def _line(number: Column, text: Column, score: Column, kind: Column, term: Column) -> Column:
    return F.struct(number.alias("line_number"), text.alias("text"), score.alias("score"), kind.alias("location_kind"), term.cast("string").alias("matched_term"))


def name_scores(files: DataFrame, q: FileQ, weights: dict | None) -> DataFrame:
    """``files`` with name_0 ...: the better of a term's scores for name and path."""
    kind = F.lit("line")
    both = {f"name_{i}": F.greatest(units.term_score(t, F.col("name"), kind, weights), units.term_score(t, F.col("rel_path"), kind, weights)) for i, t in enumerate(q.terms())}
    return files.withColumns(both)


def content_scores(
    found: DataFrame, q: FileQ, weights: dict | None, threshold: float, max_matches: int, transcript_threshold: float = units.TRANSCRIPT_THRESHOLD, preview_threshold: float = units.PREVIEW_THRESHOLD
) -> DataFrame:
    """A row per file: content_0 ... (each term's best unit), ``kept`` lines, best
    first, and ``rescued``: best units of single terms that reach the threshold
    where their whole score does not; ``near``: the best OCR or transcript unit close
    under its threshold.  Units that match no term fall out where they are scored; the
    others are shuffled once, by file, and neither written nor scored again."""
    # of a compound query a file shows its best unit for each term, however low
    least = None if q.compound else min(threshold, preview_threshold, transcript_threshold)
    scored, terms = units.score_units(found, q, weights, threshold, least), q.terms()
    names = [F.col(f"term_{i}") for i in range(len(terms))]
    scored = scored.where((F.greatest(*names) if len(names) > 1 else names[0]) > 0).repartition("file_id")
    limit = F.when(F.col("location_kind") == "transcript", transcript_threshold).otherwise(threshold)
    aggregates = []
    for i, t in enumerate(terms):
        own = names[i]
        line = F.struct(_line(F.col("line_number"), F.col("text"), own, F.col("location_kind"), F.lit(t)).alias("line"), ((F.col("score") < limit) & (own > 0) & (own >= threshold)).alias("ok"))
        aggregates += [F.max(own).alias(f"content_{i}"), F.min_by(line, F.struct(-own, F.col("unit_ord"))).alias(f"_best_{i}")]
    close = F.col("location_kind").isin(*units.PREVIEW_KINDS) & (F.col("score") < limit) & (F.col("score") >= preview_threshold)
    whole = _line(F.col("line_number"), F.col("text"), F.col("score"), F.col("location_kind"), F.lit(None))
    aggregates.append(F.min_by(F.when(close, whole), F.when(close, F.struct(-F.col("score"), F.col("unit_ord")))).alias("near"))
    kept = F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", whole.alias("line"))))
    best = units.ranked_lines(scored, threshold, max_matches, transcript_threshold).groupBy("file_id").agg(*aggregates, F.array_sort(kept).alias("_kept"))
    rescued = F.array_compact(F.array(*(F.when(F.col(f"_best_{i}")["ok"], F.col(f"_best_{i}")["line"]) for i in range(len(terms))))) if len(terms) > 1 else F.array().cast(f"array<{LINE}>")
    lines = F.when(F.size("_kept") > 0, F.transform("_kept", lambda k: k["line"]))
    return best.withColumns({"rescued": rescued, "kept": lines}).drop("_kept", *(f"_best_{i}" for i in range(len(terms))))


def merge_lines(kept: Column, rescued: Column, max_matches: int) -> Column:
    """Kept lines and those rescued at other places, one a place, best first; of
    equal scores kept lines come first."""
    other = F.filter(rescued, lambda r: ~F.exists(kept, lambda k: (k["line_number"] == r["line_number"]) & (k["location_kind"] == r["location_kind"])))
    # of several terms rescued at one place the first counts
    other = F.filter(F.transform(other, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: ~F.exists(F.slice(other, F.lit(1), x["i"]), lambda e: (e["line_number"] == x["r"]["line_number"]) & (e["location_kind"] == x["r"]["location_kind"])))
    both = F.concat(kept, F.transform(other, lambda x: x["r"]))
    ranked = F.array_sort(F.transform(both, lambda r, i: F.struct((-r["score"]).alias("s"), i.alias("i"), r.alias("r"))))
    return F.slice(F.transform(ranked, lambda x: x["r"]), 1, max_matches)


@dataclass(frozen=True)
class Pictures:
    """What tells how like a picture is to a query.  query: a query's vector.  vectors: a
    table (path, embedding) of pictures' vectors, or read: vectors of pictures' bytes,
    a function that must pickle.  Pictures without a vector are like nothing."""

    query: Callable[[str], Sequence[float]]
    vectors: DataFrame | None = None
    read: Callable[[list[bytes]], Sequence[Sequence[float]]] | None = None


def picture_scores(files: DataFrame, q: FileQ, pictures: Pictures) -> DataFrame:
    """(path, picture): cosines of pictures that are files of their own with the query,
    0 to 1; nothing for queries that are too short to mean something."""
    text = " ".join(q.terms()) or format_file_query(q)
    own = files.where(F.col("archive").isNull() & F.col("suffix").isin(*media.PICTURES) & ~F.col("names_only")).select("path")
    if len(text.strip()) < LEAST_PICTURE_QUERY:
        return own.limit(0).withColumn("picture", F.lit(0.0))
    if pictures.vectors is None:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, PICTURES_AT_ONCE):
                    paths = b.column("path").slice(at, PICTURES_AT_ONCE)
                    vectors = pictures.read([extract._read(p) for p in paths.to_pylist()])
                    yield pa.RecordBatch.from_arrays([paths, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64()))], ["path", "embedding"])

        found = own.mapInArrow(read, "path string, embedding array<double>")
    else:
        found = own.join(pictures.vectors.select("path", "embedding").dropDuplicates(["path"]), "path")
    return found.select("path", matchers.cosine(F.col("embedding"), F.lit(list(map(float, pictures.query(text))))).alias("picture"))


def search_files(
    spark: SparkSession, root: str, query: str | FileQ, *, names: bool = True, contents: bool = True, docs_tags: bool = True, ocr: bool = False, transcribe: bool = False,
    pictures: Pictures | None = None, threshold: float = units.THRESHOLD, picture_threshold: float = units.PREVIEW_THRESHOLD, transcript_threshold: float = units.TRANSCRIPT_THRESHOLD,
    limit: int | None = None, max_matches: int = 50, max_file_bytes: int | None = None, weights: dict | None = None, options: WalkOptions = WalkOptions(),
    readers: dict[str, Callable] | None = None, ports: extract.Ports | None = None, cache: UnitCache | None = None, files: DataFrame | None = None,
    written: bool = False, order: bool = True,
) -> FileSearch:
    """Files that match by name, content or picture, best first, ties by path; and what
    was too long to read, which still matches by name.  The terms of a compound query
    may be satisfied by different lines, by the name or by the picture.  cache: units
    are taken from it, and put into it where they are new.  files: a listing as
    ``list_files`` gives it, to be searched in place of the folder's; written: it is cheap
    to read several times.  order: whether results are ranked and cut to the limit."""
    if not names and not contents:
        raise ValueError("nothing to search: names and contents are both off")
    if contents and not (docs_tags or ocr or transcribe or pictures):
        raise ValueError("contents are to be searched, but none of documents and tags, writing, speech and pictures")
    q = coerce_file_query(query)
    terms = q.terms()
    if not terms:
        return FileSearch(spark.createDataFrame([], RESULTS), spark.createDataFrame([], SKIPPED))
    ports = ports or extract.Ports(readers=readers or {})
    want = extract.Wanted(docs_tags, ocr, transcribe, max_file_bytes)
    lines_wanted = contents and (docs_tags or ocr or transcribe)
    # few tasks may have listed many files: reading them is dealt out to all
    given = files is not None
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = files if given and written else few_or_once((list_files(spark, root, options) if files is None else files), parts, "files")
    files, skipped = extract.skips(listed, ports, want) if lines_wanted else (listed, spark.createDataFrame([], SKIPPED))
    rows = name_scores(files, q, weights) if names else files
    none = F.array().cast(f"array<{LINE}>")
    if lines_wanted:
        found = cache.units(files, ports, want=want) if cache else extract.units(files, ports, want, options.include_archives or given)
        rows = rows.join(content_scores(found, q, weights, threshold, max_matches, transcript_threshold, picture_threshold), "file_id", "left")
        rows = rows.withColumns({"kept": F.coalesce("kept", none), "rescued": F.coalesce("rescued", none)} | {f"content_{i}": F.coalesce(f"content_{i}", F.lit(0.0)) for i in range(len(terms))})
        rows = rows.withColumn("lines", merge_lines(F.col("kept"), F.col("rescued"), max_matches)).withColumn("content", F.coalesce(F.try_element_at("lines", F.lit(1))["score"], F.lit(0.0)))
    else:
        rows = rows.withColumns({"lines": none, "content": F.lit(0.0), "near": F.lit(None).cast(LINE)})
    rows = rows.join(picture_scores(files, q, pictures), "path", "left") if contents and pictures else rows.withColumn("picture", F.lit(None).cast("double"))
    seen = F.col("picture") > 0
    read = F.lit(lines_wanted) & ~F.col("names_only")

    def surfaces(i: int) -> dict[str, Column]:
        return ({"name": F.col(f"name_{i}")} if names else {}) | ({"content": F.when(read, F.col(f"content_{i}"))} if lines_wanted else {}) | ({"semantic_image": F.when(seen, F.col("picture"))} if pictures else {})

    def as_map(values: dict[str, Column]) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,double>")

    bests = {t: F.greatest(F.lit(0.0), *surfaces(i).values()) if surfaces(i) else F.lit(0.0) for i, t in enumerate(terms)}
    name = units.combine(q, {t: F.col(f"name_{i}") for i, t in enumerate(terms)}) if names else None
    shown = ({"name": name} if names else {}) | ({"content": F.when(read, F.col("content"))} if lines_wanted else {}) | ({"semantic_image": F.when(seen, F.col("picture"))} if pictures else {})
    total = units.combine(q, bests) if q.compound else F.greatest(F.lit(0.0), *shown.values())
    rows = rows.select(
        "path", total.alias("score"), as_map(shown).alias("breakdown"), "lines", "near", "picture",
        F.create_map(*(x for i, t in enumerate(terms) for x in (F.lit(t), as_map(surfaces(i))))).alias("term_surfaces"),
    )
    cutoff = F.when((F.try_element_at("lines", F.lit(1))["location_kind"] == "transcript") & (F.col("breakdown")["content"] >= F.col("score")), transcript_threshold)
    cutoff = cutoff.when(F.col("picture") >= F.col("score"), picture_threshold).otherwise(threshold)
    rows = rows.where((F.size("breakdown") > 0) & (F.col("score") > 0) & (F.col("score") >= cutoff))
    rows = rows.withColumn("lines", with_picture(F.col("lines"), F.col("near"), F.col("picture"), F.col("score"), max_matches)).drop("near", "picture")
    rows = rows.orderBy(F.col("score").desc(), "path") if order else rows
    return FileSearch(rows.limit(limit) if limit and order else rows, skipped)


def with_picture(lines: Column, near: Column, picture: Column, score: Column, max_matches: int) -> Column:
    """Lines as they are shown: a picture that wins stands alone, one that does not is
    put among them by its score; where there are none, a near match."""
    own = _line(F.lit(1), F.lit(VISUAL), picture, F.lit("semantic_image"), F.lit(None))
    merged = F.transform(F.array_sort(F.transform(F.concat(lines, F.array(own)), lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x.alias("x")))), lambda x: x["x"])
    shown = F.when((F.size(lines) == 0) & near.isNotNull(), F.array(near)).when(picture > 0, F.slice(merged, 1, max_matches)).otherwise(lines)
    return F.when((picture > 0) & (picture >= score - 1e-9), F.array(own)).otherwise(shown)
