"""Best results of streams, cut into micro-batches and run again."""

import random

import pytest
from pyspark.sql import functions as F

from skerry.streaming import best

SCHEMA = "query string, path string, score double, line string"


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def _rows(df):
    return sorted(((r["query"], r["rank"], r["path"], r["score"], r["line"]) for r in df.collect()), key=str)


def _results(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        score = r.choice([0.1, 0.25, 0.5, 0.5, 0.75, 1.0, None, float("nan")])
        path = r.choice([f"p{k}" for k in range(40)] + [None])
        out.append((r.choice(["a", "b", None]), path, score, f"{path} at {score}"))
    return out


def test_best_of_a_stream_is_that_of_the_table_restart_included(spark, tmp_path):
    given = spark.createDataFrame([], SCHEMA).schema
    kept = best.BestSoFar(str(tmp_path / "best"), given, 5, "path", groups=["query"])
    assert kept.now(spark).count() == 0
    seen = []
    for run in range(2):
        for part in range(3):
            rows = _results(10 * run + part, 60)
            seen += rows
            _arrive(spark, tmp_path / "in", rows)
        stream = spark.readStream.schema(given).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = kept.start(stream)
        query.awaitTermination()
        assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [60] * 3
        assert _rows(kept.now(spark)) == _rows(best.best_of(spark.createDataFrame(seen, SCHEMA), 5, "path", groups=["query"]))
    brute = {}
    for q, p, s, _ in seen:
        if s is not None and s == s:
            brute[q, p] = max(s, brute.get((q, p), 0))
    for q in ("a", "b", None):
        first = sorted(((-s, p is not None, p or "") for (g, p), s in brute.items() if g == q))[:5]
        assert [(-r["score"], r["path"] is not None, r["path"] or "") for r in sorted((r for r in kept.now(spark).collect() if r["query"] == q), key=lambda r: r["rank"])] == first


def test_a_shard_holds_no_more_than_the_limit(spark, tmp_path):
    given = spark.createDataFrame([], SCHEMA).schema
    _arrive(spark, tmp_path / "in", [(None, f"p{i}", i / 1000, "x" * 20) for i in range(1000)])
    kept = best.BestSoFar(str(tmp_path / "best"), given, 2, "path")
    kept.start(spark.readStream.schema(given).parquet(str(tmp_path / "in"))).awaitTermination()
    assert spark.conf.get(best.STORE, None) != best.PROVIDER
    lists = spark.read.parquet(str(tmp_path / "best" / "shards"))
    assert lists.groupBy("shard").count().agg(F.max("count")).first()[0] == 2 and lists.count() <= 2 * best.SHARDS
    assert [r["path"] for r in kept.now(spark).orderBy("rank").collect()] == ["p999", "p998"]
    with pytest.raises(ValueError):
        best.shards(spark.createDataFrame([], SCHEMA), 0, "path")


def test_a_batch_that_runs_again_writes_in_place(spark, tmp_path):
    kept = best.BestSoFar(str(tmp_path / "best"), spark.createDataFrame([], SCHEMA).schema, 2, "path")
    rows = spark.createDataFrame([("", 1, 1, '{"query":null,"path":"a","score":1.0,"line":"l"}')], "of string, shard int, place int, row string")
    kept._write(rows, 0)
    kept._write(rows, 0)
    assert [r["path"] for r in kept.now(spark).collect()] == ["a"]
