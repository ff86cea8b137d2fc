"""Ranked search over the rows of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..plans.query import FieldConfig, MatchType, Q
from ..plans.query import normalize as normalize_query
from . import matchers
from .layout import spread

MAGIC_THRESHOLD = 0.35


def _value(df: DataFrame, name: str) -> Column:
    return normalize(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def score_query(df: DataFrame, q: Q, query: str) -> Column:
    """One Column for a whole tree: AND is the least, OR the greatest score."""
    if q.op == "LEAF":
        return matchers.score(q.match, query, _value(df, q.field), q.composite_weights)
    scores = [score_query(df, c, query) for c in q.children]
    return (F.least if q.op == "AND" else F.greatest)(*scores)


def _config(field: str | FieldConfig) -> FieldConfig:
    return field if isinstance(field, FieldConfig) else FieldConfig(field)


def _needs_python(q: Q) -> bool:
    if q.op != "LEAF":
        return any(map(_needs_python, q.children))
    return matchers.has_python(q.composite_weights) if q.match == MatchType.COMPOSITE else q.match not in matchers.NATIVE


def _leaves(q: Q) -> dict[str, Q]:
    """The leaf that explains each field; a later one wins."""
    return {q.field: q} if q.op == "LEAF" else {k: v for c in q.children for k, v in _leaves(c).items()}


def _breakdown(df: DataFrame, q: Q, query: str) -> Column:
    entries = []
    for name, leaf in _leaves(q).items():
        scores = matchers.parts(leaf.match, query, _value(df, name), leaf.composite_weights)
        total = matchers.combined(scores, leaf.composite_weights) if leaf.match == MatchType.COMPOSITE else scores[leaf.match]
        detail = F.create_map(*(x for k, s in scores.items() for x in (F.lit(k.value), s))) if scores else F.create_map().cast("map<string,double>")
        entries += [F.lit(name), F.struct(total.alias("score"), detail.alias("parts"))]
    return F.create_map(*entries)


def discover_fields(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if not c.startswith("_"))


def _unused(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if (n + "_" * k).lower() not in taken) for n in names]


def search(df: DataFrame, query: str, *, fields: list[str | FieldConfig] | None = None, where: Q | None = None, threshold: float = 0.0, require_all: bool = False, limit: int | None = None, order: list[str] = (), breakdown: bool = False) -> DataFrame:
    """``df`` with ``score`` (and ``breakdown``), rows under the threshold dropped,
    best first; ``order`` names columns that break ties, and behind them rows keep the
    order in which the table is read."""
    if (fields is None) == (where is None):
        raise ValueError("give either fields or where")
    text = normalize_query(query)
    if not text:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    (place,) = _unused(df, "_place")
    df = df.withColumn(place, F.monotonically_increasing_id())  # before rows are dealt out
    leaves = [where] if where is not None else [Q(f.name, f.match, composite_weights=f.composite_weights) for f in map(_config, fields)]
    if any(_needs_python(q) for q in leaves):
        df = spread(df)
    if where is not None:
        rows = df.withColumn("score", score_query(df, where, text))
    else:
        configs = list(map(_config, fields))
        total = sum(f.weight for f in configs)
        if not total:
            return df.drop(place).withColumn("score", F.lit(0.0)).limit(0)
        each = [matchers.score(f.match, text, _value(df, f.name), f.composite_weights) for f in configs]
        weighted = sum((s * f.weight for s, f in zip(each, configs, strict=True)), F.lit(0.0)) / total
        rows = df.withColumn("score", weighted)
        if require_all:
            least = F.least(*each) if len(each) > 1 else each[0]
            rows = rows.withColumn("_least", least).where((F.col("_least") > 0) & (F.col("_least") >= threshold)).drop("_least")
        where = Q.any(*(Q(f.name, f.match, f.weight, f.composite_weights) for f in configs))
    if breakdown:
        rows = rows.withColumn("breakdown", _breakdown(df, where, text))
    rows = rows.where((F.col("score") > 0) & (F.col("score") >= threshold)).orderBy(F.col("score").desc(), *order, place)
    return (rows.limit(limit) if limit else rows).drop(place)


def magic_search(df: DataFrame, query: str, *, fields: list[str] | None = None, threshold: float = MAGIC_THRESHOLD, **more) -> DataFrame:
    """Search all fields at once: the best composite score of any."""
    names = fields or discover_fields(df)
    return search(df, query, where=Q.any(*(Q.composite(n) for n in names)), threshold=threshold, **more)


def hit_rate(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(rate): the share of ``expected`` (query, id) whose id is among the first ``k`` of
    its query in ``ranked`` (query, id, rank), ranks from 1."""
    hits = ranked.where(F.col("rank") <= k).select("query", "id").distinct().withColumn("_hit", F.lit(1.0))
    return expected.join(hits, ["query", "id"], "left").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("rate"))
