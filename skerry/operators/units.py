"""Text units: lines of documents scored by a term query, the best lines of each
document, and document scores.

``units``: file_id, unit_ord, line_number, text, location_kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize, query_words, tag_value, tokens
from ..plans.query import FileQ, MatchType
from . import matchers
from .layout import spread

# Fixed values.
THRESHOLD, TRANSCRIPT_THRESHOLD, PREVIEW_THRESHOLD = 0.35, 0.25, 0.18
TOKEN_KINDS = ("ocr", "tag", "transcript")
PREVIEW_KINDS = ("ocr", "transcript")


def lines(df: DataFrame, file_id: str, text: str, kind: str = "line") -> DataFrame:
    """Units of a text column, split at universal newlines, numbered from 1."""
    parts = F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("unit_ord", "text")
    rows = spread(df.select(F.col(file_id).alias("file_id"), F.col(text))).select("file_id", parts)
    return rows.select("file_id", "unit_ord", (F.col("unit_ord") + 1).alias("line_number"), "text", F.lit(kind).alias("location_kind"))


def unit_body(text: Column, kind: Column) -> Column:
    """What is scored of a unit: its text, of a tag without the label."""
    return normalize(F.when(kind == "tag", tag_value(text)).otherwise(text))


def term_score(term: str, text: Column, kind: Column, weights: dict | None, rescue_below: float | None = None, body: Column | None = None, least: float | None = None) -> Column:
    """Score of one unit for one term.  Several query words: each needs a token, the
    weakest counts.  One word: the best token for tags, OCR and transcripts, else
    the whole line; with an encoder, a line near in meaning whose score is under
    ``rescue_below`` gets its cosine.  Weights of native matchers alone stay in the JVM.
    body: a column of ``unit_body``, where there is one.  least: whole lines that cannot
    reach so much may get 0."""
    words = list(dict.fromkeys(query_words(term)))
    body = unit_body(text, kind) if body is None else body
    if len(query_words(term)) >= 2:
        best = [matchers.best_token(w, tokens(body), weights, among_words=True) for w in words]
        return F.least(*best) if len(best) > 1 else best[0]
    token_kind = kind.isin(*TOKEN_KINDS)
    # Python functions run on all rows, whatever branch they are in: each gets its own
    whole_body = F.when(~token_kind, body).otherwise("") if matchers.has_python(weights) else body
    own_tokens = F.when(token_kind, tokens(body)) if matchers.has_python(weights) else tokens(body)
    active = matchers.active_weights(weights)
    if matchers.has_python(weights) and MatchType.SEMANTIC not in active:
        found, whole = {}, matchers.composite(term, whole_body, weights, least)
    else:
        found = matchers.parts(MatchType.COMPOSITE, term, whole_body, weights)
        whole = matchers.combined(found, weights)
    if rescue_below is not None and MatchType.SEMANTIC in found:
        near = found[MatchType.SEMANTIC]
        whole = F.when((near >= matchers.TOKEN_COSINE) & (whole < rescue_below), F.greatest(whole, near)).otherwise(whole)
    return F.when(token_kind, matchers.best_token(term, own_tokens, weights, among_words=False)).otherwise(whole)


def vocabulary_scores(rows: DataFrame, key: list[str], text: str, word: str, weights: dict | None = None) -> DataFrame:
    """(key, score): the best token of each row for one word, by a join with the table's
    vocabulary: every distinct token is scored once, however many rows and tasks have it.
    Rows without a token that counts are left out.  Worth its shuffles where scoring
    runs in Python and texts repeat their words."""
    seen = spread(rows).select(*key, F.explode(F.array_distinct(tokens(normalize(F.col(text))))).alias("token"))
    known = seen.select("token").distinct().withColumn("score", matchers.best_token(word, F.array("token"), weights, among_words=False))
    return seen.join(known.where("score > 0"), "token").groupBy(*key).agg(F.max("score").alias("score"))


def combine(q: FileQ, columns: dict[str, Column]) -> Column:
    if q.op == "LEAF":
        return columns.get(q.value, F.lit(0.0))
    return (F.least if q.op == "AND" else F.greatest)(*(combine(c, columns) for c in q.children))


def _settled(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that are made once: filters on them are not carried below a
    generator, and so do not repeat what makes them."""
    kept = [c for c in rows.columns if c not in values]
    return rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))


def score_units(units: DataFrame, q: FileQ, weights: dict | None = None, threshold: float = THRESHOLD, least: float | None = None) -> DataFrame:
    """``units`` with term_0 ... and ``score``; blank units are dropped.  least: units
    that cannot reach so much may get 0."""
    text, kind = F.col("text"), F.col("location_kind")
    scored = _settled(units, {"_body": unit_body(text, kind)})
    scored = scored.where((F.col("_body") != "") | (kind == "tag") & (normalize(text) != ""))
    names = {t: f"term_{i}" for i, t in enumerate(q.terms())}
    scores = {n: term_score(t, text, kind, weights, threshold, F.col("_body"), least) for t, n in names.items()}
    # Spark would run Python functions again for each filter on what they give
    scored = _settled(scored.withColumns(scores), {n: F.col(n) for n in names.values()}) if matchers.has_python(weights) else scored.withColumns(scores)
    scored = scored.drop("_body")
    return scored.withColumn("score", combine(q, {t: F.col(n) for t, n in names.items()}))


def kept_lines(scored: DataFrame, threshold: float = THRESHOLD, max_matches: int = 50, transcript_threshold: float = TRANSCRIPT_THRESHOLD) -> DataFrame:
    """The best units of each file with ``rank``; of those with one line number and
    kind only the best.  Lines, pages, paragraphs, rows and slides have places of their
    own: only what token kinds repeat is shuffled by place, and where a table has one
    kind alone, that branch falls away."""
    limit = F.when(F.col("location_kind") == "transcript", transcript_threshold).otherwise(threshold)
    best = [F.col("score").desc(), F.col("unit_ord")]
    same = Window.partitionBy("file_id", "line_number", "location_kind").orderBy(*best)
    own = Window.partitionBy("file_id").orderBy(*best)
    rows = scored.where((F.col("score") > 0) & (F.col("score") >= limit))
    repeats = F.col("location_kind").isin(*TOKEN_KINDS)
    single = rows.where(repeats).withColumn("_first", F.row_number().over(same)).where("_first = 1").drop("_first")
    rows = rows.where(~repeats).unionByName(single)
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= max_matches)


def ranked_lines(scored: DataFrame, threshold: float = THRESHOLD, max_matches: int = 50, transcript_threshold: float = TRANSCRIPT_THRESHOLD) -> DataFrame:
    """All units, those that ``kept_lines`` keeps with their ``rank``, others with none;
    where units are partitioned by file, nothing is shuffled."""
    limit = F.when(F.col("location_kind") == "transcript", transcript_threshold).otherwise(threshold)
    rows = scored.withColumn("_ok", (F.col("score") > 0) & (F.col("score") >= limit))
    best = [F.col("_ok").desc(), F.col("score").desc(), F.col("unit_ord")]
    same = Window.partitionBy("file_id", "line_number", "location_kind").orderBy(*best)
    rows = rows.withColumn("_ok", F.col("_ok") & (~F.col("location_kind").isin(*TOKEN_KINDS) | (F.row_number().over(same) == 1)))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(*best))
    return rows.withColumn("rank", F.when(F.col("_ok") & (rank <= max_matches), rank)).drop("_ok")


def file_scores(scored: DataFrame, q: FileQ, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, score): terms may be satisfied by different units of a file.  The
    aggregate combines map-side, one shuffle on file_id."""
    names = {t: f"term_{i}" for i, t in enumerate(q.terms())}
    best = scored.groupBy("file_id").agg(*(F.max(n).alias(n) for n in names.values()))
    rows = best.withColumn("score", combine(q, {t: F.col(n) for t, n in names.items()}))
    return rows.where((F.col("score") > 0) & (F.col("score") >= threshold))


def number_ranges(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers per key, as text: 1-3, 7."""
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    runs = rows.select(*keys, number).distinct().withColumn("_run", island).groupBy(*keys, "_run").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda s: s["t"]), ", ").alias("ranges"))
