"""Results of a file search as JSON rows, flat lines, merged lines and blocks of text,
and back from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.previews import snippets
from ..functions.text import clock, collapse, percent
from ..plans.query import FileQ, display_query, format_file_query
from . import units

PREVIEW = 100
# Kinds that count as content, and names of places.
CONTENT_KINDS = ("line", "page", "paragraph", "row", "slide")
PLACES = {"semantic_image": "image"}
MIB = 1 << 20
MORE = "..."


def _place(kind: Column) -> Column:
    out = kind
    for k, name in PLACES.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def location_label(kind: Column, number: Column) -> Column:
    """line 5, image 1; transcript at 02:40."""
    return F.when(kind == "transcript", F.concat(F.lit("transcript at "), clock(number))).otherwise(F.concat_ws(" ", _place(kind), number.cast("string")))


def preview(text: Column, terms: list[str], length: int = PREVIEW) -> Column:
    """At most ``length`` characters and two ellipses around the first place of the
    first term that occurs, which is put in guillemets; the beginning if none does."""
    flat = collapse(text)
    low = F.lower(flat)
    at, size = F.lit(0), F.lit(0)
    for t in reversed(terms):
        at, size = F.when(F.locate(t, low) > 0, F.locate(t, low)).otherwise(at), F.when(F.locate(t, low) > 0, len(t)).otherwise(size)
    budget = F.greatest(F.lit(0), F.lit(length - 2) - size)
    whole = F.length(flat) + 2 <= length
    first = F.when(whole, 1).otherwise(F.greatest(F.lit(1), at - F.floor(budget / 2))).cast("int")
    behind = (at + size).cast("int")
    last = F.when(whole, F.length(flat)).otherwise(F.least(F.length(flat), behind - 1 + budget - F.floor(budget / 2))).cast("int")
    marked = F.concat(
        F.when(first > 1, MORE).otherwise(""), F.substring(flat, first, (at - first).cast("int")), F.lit("«"), F.substring(flat, at.cast("int"), size.cast("int")), F.lit("»"),
        F.substring(flat, behind, (last - behind + 1).cast("int")), F.when(last < F.length(flat), MORE).otherwise(""),
    )
    beginning = F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.substring(flat, 1, length - len(MORE)), F.lit(MORE)))
    return F.when(at > 0, marked).otherwise(beginning)


def json_rows(results: DataFrame, q: FileQ, marks: str = "guillemets") -> DataFrame:
    """(path, score, json): one object for each file.  Previews mark places that are
    only like a term, too; they are made of the few lines kept."""
    shown = results.withColumn("_previews", snippets(F.col("lines"), q, PREVIEW, marks))
    lines = F.transform(F.arrays_zip("lines", "_previews"), lambda z: F.struct(
        z["lines"]["line_number"].alias("line_number"), z["lines"]["location_kind"].alias("location_kind"),
        location_label(z["lines"]["location_kind"], z["lines"]["line_number"]).alias("location_label"),
        z["_previews"].alias("preview"), z["lines"]["text"].alias("text"), z["lines"]["score"].alias("score"),
    ))
    return shown.select("path", "score", F.to_json(F.struct("path", "score", "breakdown", "term_surfaces", lines.alias("lines"))).alias("json"))


def packed(results: DataFrame) -> DataFrame:
    """(json): each result whole, as ``unpacked`` reads it."""
    return results.select(F.to_json(F.struct("path", "score", "breakdown", "term_surfaces", "lines"), {"ignoreNullFields": "false"}).alias("json"))


def unpacked(rows: DataFrame, schema: str | StructType) -> DataFrame:
    """Results from ``packed`` rows; schema: that of results, or of skips."""
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def flat_lines(results: DataFrame) -> DataFrame:
    """(path, ord, flat): path:kind:line:percent:text, the name's hit first."""
    base = F.element_at(F.split(F.element_at(F.split("path", "::"), -1), "/"), -1)
    name = F.when(F.coalesce(F.col("breakdown")["name"], F.lit(0.0)) > 0, F.concat_ws(":", "path", F.lit("name"), F.lit("0"), percent(F.col("breakdown")["name"]), base))
    hits = F.transform("lines", lambda x: F.concat_ws(":", F.col("path"), x["location_kind"], x["line_number"].cast("string"), percent(x["score"]), collapse(x["text"])))
    return results.select("path", F.posexplode(F.concat(F.array_compact(F.array(name)), hits)).alias("ord", "flat"))


def match_labels(results: DataFrame, threshold: float = units.THRESHOLD, picture_threshold: float = units.PREVIEW_THRESHOLD, transcript_threshold: float = units.TRANSCRIPT_THRESHOLD) -> DataFrame:
    """(path, labels): on which surfaces a file reaches the thresholds, by name first;
    "match" where it does on none."""

    def reaches(surface: str) -> Column:
        return F.exists(F.map_values("term_surfaces"), lambda m: F.coalesce(m[surface], F.lit(0.0)) >= threshold)

    kind = lambda x: x["location_kind"]
    least = lambda x: F.when(kind(x) == "transcript", transcript_threshold).when(kind(x) == "semantic_image", picture_threshold).otherwise(threshold)
    label = lambda x: F.when(kind(x).isin(*CONTENT_KINDS), "content").when(kind(x) == "semantic_image", "image semantic").otherwise(kind(x))
    none = F.array().cast("array<string>")
    when = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(none)
    of_lines = F.transform(F.filter("lines", lambda x: x["score"] >= least(x)), label)
    picture = F.coalesce(F.col("breakdown")["semantic_image"], F.lit(0.0))
    whole = F.concat(
        when(reaches("name"), "name"), of_lines, when((F.size("lines") == 0) & reaches("content"), "content"), when((picture >= picture_threshold) & (picture >= F.col("score") - 1e-9), "image semantic"),
    )
    distinct = F.array_distinct(whole)
    return results.select("path", F.when(F.size(distinct) > 0, F.array_join(distinct, ", ")).otherwise("match").alias("labels"))


def grouped_lines(results: DataFrame, q: FileQ) -> DataFrame:
    """(path, score, location_kind, matched_term, preview, first, numbers, ranges): lines
    of one file that look the same are one, their numbers as ranges."""
    shown = results.withColumns({"_plain": snippets(F.col("lines"), q, PREVIEW, "none"), "_marked": snippets(F.col("lines"), q)})
    rows = shown.select("path", F.posexplode(F.arrays_zip("lines", "_plain", "_marked")).alias("ord", "z")).select("path", "ord", "z.lines.*", F.col("z._plain").alias("plain"), F.col("z._marked").alias("preview"))
    keys = ["path", "score", "location_kind", "plain"]
    groups = rows.groupBy(*keys).agg(F.min("ord").alias("first"), F.min_by("preview", "ord").alias("preview"), F.min_by("matched_term", "ord").alias("matched_term"), F.array_sort(F.collect_list("line_number")).alias("numbers"))
    ranges = units.number_ranges(rows, keys, "line_number")
    same = [groups[k].eqNullSafe(ranges[k]) for k in keys]
    return groups.join(ranges, same).select(groups["path"], groups["score"], groups["location_kind"], "matched_term", "preview", "first", "numbers", "ranges")


def text_blocks(results: DataFrame, q: FileQ) -> DataFrame:
    """(path, score, block): a file's path, percentage and kinds of match, then its
    lines, best first, those that look the same as one.  Best files first."""
    number = F.col("numbers")
    several = F.concat(_place(F.col("location_kind")), F.when(F.size(number) > 1, "s").otherwise(""), F.lit(" "), F.col("ranges"))
    spoken = F.concat(F.lit("transcript at "), F.array_join(F.transform(number, clock), ", "))
    where = F.concat(F.when(F.col("location_kind") == "transcript", spoken).otherwise(several), F.when(F.col("matched_term").isNotNull(), F.concat(F.lit(' · "'), "matched_term", F.lit('"'))).otherwise(""))
    line = F.concat(F.lit("   "), where, F.lit("  ·  match "), percent(F.col("score")), F.lit("\n   │ "), "preview")
    lines = grouped_lines(results, q).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first", line.alias("line")))).alias("g"))
    rows = results.select("path", "score").join(match_labels(results), "path").join(lines, "path", "left")
    head = F.concat(F.lit("── "), "path", F.lit(" ──\n   match "), percent(F.col("score")), F.lit("  ·  matched: "), "labels")
    return rows.select("path", "score", F.concat_ws("\n", head, F.transform("g", lambda x: x["line"])).alias("block")).orderBy(F.col("score").desc(), "path")


def summary(n: int, q: FileQ | str) -> str:
    """How many files matched what."""
    text = q if isinstance(q, str) else format_file_query(q)
    return f"{n} file{'s' * (n != 1)} matched" + (f' for "{display_query(text)}"' if text else "")


def skip_warning(path: str, size: int, reason: str, limit: int | None) -> str:
    """Why content was not read, and what would let it: the limit is the one of the
    surface; of content the next whole MiB above the size is named."""
    shown = f"{limit:,}" if limit is not None else "limit"
    what, flag = {"ocr_too_large": ("OCR", "--max-ocr-file-size"), "transcribe_too_large": ("transcription", "--max-transcribe-file-size")}.get(reason, ("content search", "--max-file-size"))
    hint = f"increase {flag}" if reason in ("ocr_too_large", "transcribe_too_large") else f"rerun with {flag} {(size // MIB + 1) * MIB}"
    return f"warning: skipped {what} in {path} ({size:,} bytes > {flag} {shown})\n  hint: {hint}"


def write_results(results: DataFrame, q: FileQ, folder: str, form: str = "json") -> None:
    """Ranked results as text files of a new folder, JSON rows, flat lines or blocks, best
    first from file to file.  Tasks write them, and none is there before all are: a task
    that is lost leaves nothing behind."""
    rows = {"json": lambda: json_rows(results, q).select("json"), "grouped": lambda: text_blocks(results, q).select("block"), "flat": lambda: flat_lines(results).select("flat")}
    if form not in rows:
        raise ValueError(f"form is one of {', '.join(rows)}")
    rows[form]().write.text(folder)
