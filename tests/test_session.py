"""Previews of misspelt places, the unit cache, sessions with events."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skerry import cli
from skerry.functions import kernels
from skerry.functions.previews import find_span, snippet, snippets
from skerry.plans.query import parse_file_query
from skerry.operators import output
from skerry.operators.file_search import FileSearch, search_files
from skerry.operators.session import Activity, Failed, Finished, Result, Results, SearchSession, paced
from skerry.sources import extract
from skerry.sources.cache import UnitCache, oldest_that_stays
from skerry.sources.files import list_files


def _cut(text, term):
    a, b = find_span(text, term)
    return text[a:b]


def test_places_of_terms():
    assert _cut("Quarterly Revenue plan", "revenue") == "Revenue"
    assert _cut("plan of revenue, quarterly", "quarterly revenue") == "revenue, quarterly"
    assert _cut("the revenu plan", "revenue") in ("revenu ", "revenu", " revenu")
    assert _cut("zzz", "revenue") == "z" and _cut("", "x") == "" and _cut("abc", " ") == "a" and _cut("zzz", "far cry") in ("", "z")
    assert kernels.partial_alignment("abc", "xxabcx") == (100.0, 2, 5)


def test_snippets(spark):
    q = lambda t: parse_file_query(t)
    assert snippet("[Author] ann  lee", q("lee")) == "[Author] ann «lee»"
    assert snippet("[Intro: x] lee", q("intro")) == "[«Intro»: x] lee" and snippet("[Author]", q("lee")) == "[Author]"
    assert snippet("a <b> needle", q("needle"), marks="html") == "a &lt;b&gt; <b>needle</b>"
    assert snippet("x [red] needle", q("needle"), marks="bold") == "x \\[red] [bold]needle[/bold]"
    long = snippet("a " * 200 + "needle" + " b" * 200, q("needle"))
    assert "«needle»" in long and len(long) <= 106 and long.startswith("...") and long.endswith("...")
    assert snippet(None, q("x")) is None and snippet("", q("x")) == "" and len(snippet("q" * 300, q("far cry"))) == 100
    assert snippet("plan of revenue, quarterly", q("quarterly revenue")) == "plan of «revenue, quarterly»"
    assert snippet("only revenue here", q("quarterly revenue")) == "only «revenue» here" and snippet("neither here", q("quarterly revenue")) == "neither here"
    assert snippet("alpha and beta", q("alpha & beta"), term="beta") == "alpha and «beta»" and snippet("zzz", q("needle")) == "«z»zz"
    kind = "t array<struct<text: string, matched_term: string, location_kind: string>>"
    rows = spark.createDataFrame([([("a needle", None, "line"), (None, None, "line"), ("(visual match)", None, "semantic_image")],), (None,), ([],)], kind)
    assert [r["s"] for r in rows.select(snippets(F.col("t"), q("needle")).alias("s")).collect()] == [["a «needle»", None, "(visual match)"], None, []]
    assert "--max-file-size 2097152" in output.skip_warning("x", (1 << 20) + 1, "oversized", 1 << 20) and "--max-file-size 2097152" in output.skip_warning("x", 1 << 20, "oversized", 5)


def test_cache_reads_only_what_is_new(spark, tmp_path):
    tree, store = tmp_path / "tree", str(tmp_path / "cache")
    tree.mkdir()
    (tree / "a.txt").write_text("one\ntwo")
    (tree / "b.txt").write_text("one\ntwo")
    reads = tmp_path / "reads"
    reads.mkdir()

    def counting(data):
        with open(reads / "log", "a") as f:
            f.write("x")
        return extract.plain(data)

    def run():
        rows = UnitCache(spark, store).units(list_files(spark, str(tree)), {".txt": counting})
        return sorted(r["text"] for r in rows.collect()), len((reads / "log").read_text()) if (reads / "log").exists() else 0

    assert run() == (["one", "one", "two", "two"], 1)
    assert run() == (["one", "one", "two", "two"], 1)
    (tree / "b.txt").write_text("three!")
    assert run() == (["one", "three!", "two"], 2)
    cache = UnitCache(spark, store)
    assert cache.size() == 13
    (tree / "b.txt").unlink()
    run()
    cache.evict(7)
    assert UnitCache(spark, store).size() == 7 and run() == (["one", "two"], 2)


def test_what_stays_in_the_cache_is_what_running_totals_keep(spark):
    r = random.Random(9)
    times = sorted(r.choice([r.random() * 1e9, 1e9 + k * 1e-6, 5.0]) for k in range(80))
    rows = [(t, r.choice([0, 1, 10, 1000])) for t in times for _ in range(r.choice([1, 1, 3]))]
    dated = spark.createDataFrame(rows, "used_at double, size_bytes long")
    for bound in (0, 1, 17, 1000, 5003, 20_000, 10**9):
        total, stays = 0, float("inf")
        for t in sorted(set(times), reverse=True):
            total += sum(n for x, n in rows if x == t)
            if total > bound:
                break
            stays = t
        assert oldest_that_stays(dated, bound, bins=4) == oldest_that_stays(dated, bound) == stays, bound
    assert oldest_that_stays(dated.limit(0), 5) == float("inf")
    plan = dated.where(F.col("used_at") >= oldest_that_stays(dated, 17))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_results_are_written_by_tasks(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    for i in range(7):
        (tmp_path / "tree" / f"a{i}.txt").write_text("alpha\n" * (i + 1))
    q = parse_file_query("alpha")
    found = search_files(spark, str(tmp_path / "tree"), q, weights={"contains": 1.0}).results
    for form in ("json", "flat", "grouped"):
        output.write_results(found, q, str(tmp_path / form), form)
    read = lambda form: [line for p in sorted((tmp_path / form).glob("part-*")) for line in p.read_text().splitlines()]
    assert [json.loads(x) for x in read("json")] == [json.loads(r["json"]) for r in output.json_rows(found, q).collect()] and len(read("json")) == 7
    assert read("flat") == [r["flat"] for r in output.flat_lines(found).collect()] and len(read("flat")) == 28
    assert "\n".join(read("grouped")) == "\n".join(r["block"] for r in output.text_blocks(found, q).collect())
    with pytest.raises(ValueError):
        output.write_results(found, q, str(tmp_path / "x"), "xml")
    assert cli.main(["alpha", str(tmp_path / "tree"), "--content-only", "--output-folder", str(tmp_path / "out"), "--json"], spark) == 0
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 7
    assert cli.main(["zzzzqqqq", str(tmp_path / "tree"), "--threshold", "0.99", "--output-folder", str(tmp_path / "none")], spark) == 1


def test_session_events_and_cancelling(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    seen = []
    rows = SearchSession(spark, seen.append).run(lambda: search_files(spark, str(tmp_path), "alpha", weights={"contains": 1.0}))
    assert rows == 1 and isinstance(seen[0], Activity) and any(isinstance(e, Result) for e in seen)
    assert seen[-1] == Finished(1) and not any(isinstance(e, Failed) for e in seen)

    def fail():
        raise ValueError("no")

    seen.clear()
    with pytest.raises(ValueError):
        SearchSession(spark, seen.append).run(fail)
    assert seen[-1] == Failed("no")

    seen.clear()
    session = SearchSession(spark, seen.append)

    def cancelled():
        session.cancel()
        return search_files(spark, str(tmp_path), "alpha", weights={"contains": 1.0})

    assert session.run(cancelled) == 0 and seen[-1].cancelled

    many = spark.range(600).selectExpr("id")
    seen.clear()
    none = spark.createDataFrame([], "path string, size_bytes long, reason string")
    assert SearchSession(spark, seen.append).run(lambda: FileSearch(many, none)) == 600
    assert sum(isinstance(e, Result) for e in seen) == 250 and [len(e.rows) for e in seen if isinstance(e, Results)] == [250, 100]

    told = []
    report = paced(lambda d, t: told.append(d), 60)
    for i in range(5):
        report(i, 4)
    assert told == [0, 4]
