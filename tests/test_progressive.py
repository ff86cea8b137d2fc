"""Searches in parts: results before the end, counts of files, cancelling."""

import random
import time

import pytest
from pyspark.sql import functions as F

import skerry
from skerry.operators import progressive, session
from skerry.operators.file_search import search_files
from skerry.operators.progressive import ProgressiveSearch, part_of
from skerry.operators.session import Finished, Progress, Result, SearchSession, Skipped

WEIGHTS = {"contains": 0.6, "exact": 0.4}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("tree"), random.Random(6)
    for i in range(120):
        lines = [r.choice(["alpha", "an alpha line", "nothing", "beta"]) for _ in range(r.randint(0, 3))]
        (root / f"f{i:03d}.txt").write_text("\n".join(lines))
    return root


def _rows(df):
    return [(r["path"], r["score"], len(r["lines"])) for r in df.collect()]


def test_parts_share_paths_out(spark):
    paths = spark.range(20_000).select(F.concat(F.lit("/p/"), "id").alias("p"))
    n = {r["k"]: r["count"] for r in paths.groupBy(part_of(F.col("p"), 5).alias("k")).count().collect()}
    assert sorted(n) == [0, 1, 2, 3, 4] and sum(n.values()) == 20_000
    assert all(abs(n[k] / 20_000 - share) < 0.02 for k, share in enumerate([1 / 16, 1 / 16, 1 / 8, 1 / 4, 1 / 2]))


@pytest.mark.parametrize("limit", [None, 1, 7, 500])
def test_all_parts_give_the_ranked_answer(spark, tree, limit):
    whole = search_files(spark, str(tree), "alpha", names=False, weights=WEIGHTS, limit=limit).results
    seen = []
    search = ProgressiveSearch(spark, str(tree), "alpha", limit=limit, parts=4, names=False, weights=WEIGHTS)
    found = search.run(lambda part: seen.append((part.completed, part.total, part.matches, _rows(part.results))))
    assert _rows(found.results) == _rows(whole)
    assert [c for c, *_ in seen] == sorted({c for c, *_ in seen}) and seen[-1][:2] == (120, 120)
    assert seen[-1][2] == search_files(spark, str(tree), "alpha", names=False, weights=WEIGHTS).results.count()
    assert {x for *_, rows in seen for x in rows} >= set(_rows(whole))
    if limit == 1:  # what cannot be the best is not written
        assert sum(len(rows) for *_, rows in seen) <= 4


def test_what_was_found_before_cancelling_is_right(spark, tree):
    stop, whole = [], dict((p, s) for p, s, _ in _rows(search_files(spark, str(tree), "alpha", names=False, weights=WEIGHTS).results))
    search = ProgressiveSearch(spark, str(tree), "alpha", parts=4, names=False, weights=WEIGHTS)
    found = search.run(lambda part: stop.append(part.completed), lambda: len(stop) == 2)
    rows = _rows(found.results)
    assert 0 < len(rows) < len(whole) and all(whole[p] == s for p, s, _ in rows) and search.completed == stop[-1] < 120
    assert [s for _, s, _ in rows] == sorted((s for _, s, _ in rows), reverse=True)


def test_events_of_a_search_in_parts(spark, tree):
    seen = []
    run = SearchSession(spark, seen.append)
    n = run.run(ProgressiveSearch(spark, str(tree), "alpha", parts=4, names=False, weights=WEIGHTS, max_file_bytes=12))
    told = [e for e in seen if isinstance(e, Progress)]
    assert told[-1] == Progress(120, 120) and 2 <= len(told) <= 4
    first = next(i for i, e in enumerate(seen) if isinstance(e, Result))
    assert first < max(i for i, e in enumerate(seen) if isinstance(e, Progress))
    assert n == sum(isinstance(e, Result) for e in seen) == seen[-1].count
    skips = [r for e in seen if isinstance(e, Skipped) for r in e.rows]
    assert seen[-1] == Finished(n, False, len(skips)) and skips

    seen.clear()
    run = SearchSession(spark, lambda e: (seen.append(e), isinstance(e, Result) and run.cancel()))
    search = ProgressiveSearch(spark, str(tree), "alpha", parts=4, names=False, weights=WEIGHTS)
    run.run(search)
    assert seen[-1].cancelled and 1 <= sum(isinstance(e, Result) for e in seen) and search.completed < 120


def test_all_skips_are_told(spark, tree, monkeypatch):
    monkeypatch.setattr(session, "RESULT_EVENTS", 10)
    skipped = []
    skerry.magic_file_search(str(tree), "alpha", search_names=False, max_file_size=6, skipped_files=skipped, spark=spark)
    assert len(skipped) == sum(p.stat().st_size > 6 for p in tree.iterdir()) > 30


def test_plain_calls_are_cancelled_between_events(spark, tree, monkeypatch):
    monkeypatch.setattr(progressive, "LEAST_FILES", 1)
    began = time.monotonic()
    found = skerry.magic_file_search(str(tree), "alpha", search_names=False, cancel_check=lambda: time.monotonic() - began > 0.2, spark=spark)
    whole = skerry.magic_file_search(str(tree), "alpha", search_names=False, limit=9, spark=spark)
    assert len(found) < 120 and len(whole) == 9 and [r.score for r in whole] == sorted((r.score for r in whole), reverse=True)
    with pytest.raises(RuntimeError):
        skerry.magic_file_search(str(tree), "alpha", ocr=True, spark=spark)
