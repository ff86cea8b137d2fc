"""The file tree as a data source: rows, filters that the walk makes, increments."""

import os
import time

import pytest
from pyspark.sql import functions as F

from skerry.sources import tree
from skerry.sources.files import WalkOptions, list_files


@pytest.fixture
def folder(spark, tmp_path):
    tree.register(spark)
    for k, name in enumerate(["a.txt", "b.MD", ".env", "yarn.lock", "sub/x.txt", "sub/deep/y.txt", "other/z.md", ".git/w.txt", "node_modules/v.js", "sub/.hid", "noext", ".tar.gz", "q.tar.gz"]):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * k)
    return tmp_path / "root"


def read(spark, folder, **options):
    return spark.read.format("skerry_files").options(**options).load(str(folder))


def names(df):
    return sorted(r["rel_path"] for r in df.collect())


@pytest.mark.parametrize("options", [WalkOptions(), WalkOptions(match_skipped_names=True), WalkOptions(False, False, False), WalkOptions(include_subdirectories=False), WalkOptions(skip_noise_files=False)])
def test_rows_are_those_of_the_listing(spark, folder, options, monkeypatch):
    columns = ["path", "rel_path", "name", "suffix", "size_bytes", "mtime_ns", "names_only"]
    given = {k: str(v).lower() for k, v in vars(options).items()}
    got = read(spark, folder, **given).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, list_files(spark, str(folder), options).select(*columns).collect()))


def test_filters_are_made_by_the_walk(spark, folder):
    cases = {
        "suffix = '.txt'": ["a.txt", "sub/deep/y.txt", "sub/x.txt"], "suffix IN ('.md', '.gz')": ["b.MD", "other/z.md", "q.tar.gz"],
        "size_bytes > 4 AND size_bytes <= 6": ["other/z.md", "sub/deep/y.txt"], "rel_path LIKE 'sub/%'": ["sub/deep/y.txt", "sub/x.txt"], "path LIKE '%/y.txt'": ["sub/deep/y.txt"],
        "rel_path = 'sub/x.txt'": ["sub/x.txt"], "size_bytes = 0": ["a.txt"], "mtime_ns < 5": [], "name LIKE 'n%'": ["noext"], "size_bytes >= 12 OR suffix = '.md'": ["b.MD", "other/z.md", "q.tar.gz"],
        "upper(name) = 'NOEXT'": ["noext"], "suffix <> '.txt' AND size_bytes < 2": ["b.MD"], "suffix IS NULL": [],
    }
    for where, want in cases.items():
        assert names(read(spark, folder, push="true").where(where)) == want, where
    asked = read(spark, folder, push="true").where("suffix = '.txt' AND size_bytes > 3")
    plan = spark._jvm.PythonSQLUtils.explainString(asked._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(suffix,.txt), GreaterThan(size_bytes,3)]" in plan and "= .txt" not in plan


def test_one_table_answers_many_queries(spark, folder):
    rows = read(spark, folder)
    whole = names(rows)
    assert names(rows.where("suffix = '.txt'")) == ["a.txt", "sub/deep/y.txt", "sub/x.txt"] and names(rows) == whole


def test_options_ask_as_filters_do(spark, folder):
    assert names(read(spark, folder, suffixes=".md, .GZ")) == ["b.MD", "other/z.md", "q.tar.gz"]
    assert names(read(spark, folder, min_bytes="5", max_bytes="6")) == ["other/z.md", "sub/deep/y.txt"]
    assert names(read(spark, folder, under="sub/d")) == ["sub/deep/y.txt"]


def test_beginnings_leave_out_folders_and_partitions(spark, folder):
    assert read(spark, folder).rdd.getNumPartitions() == 4  # the root, other, sub, sub/deep
    assert read(spark, folder, push="true").where("rel_path LIKE 'sub/deep/%'").rdd.getNumPartitions() == 3
    assert read(spark, folder, push="true").where("rel_path LIKE 'other/%'").rdd.getNumPartitions() == read(spark, folder, under="other/").rdd.getNumPartitions() == 2
    assert read(spark, folder, partitions="2").rdd.getNumPartitions() == 2
    os.chmod(folder / "other", 0o755)
    walk = tree.Walk(str(folder), WalkOptions(), (("rel_path", "starts", "su"),))
    assert [os.path.basename(f) for f, _ in [s for p in walk.partitions(9) for s in p.seeds]] == ["root", "sub", "deep"]


def test_folders_that_are_not_there(spark, folder):
    with pytest.raises(Exception, match="none"):
        read(spark, folder / "none").collect()
    (folder / "empty").mkdir()
    assert read(spark, folder / "empty").count() == 0


def test_a_stream_lists_only_what_is_new(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("skerry_files").option("settle_seconds", "0.05").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    time.sleep(0.2)
    assert run() == 7
    assert run() == 0
    (folder / "sub" / "new.txt").write_text("n")
    os.utime(folder / "sub" / "new.txt", (1, 1))  # comes with an old date
    (folder / "a.txt").write_text("changed")
    time.sleep(0.2)
    assert run() == 2
    seen = [r["rel_path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(seen) == sorted([*names(read(spark, folder)), "a.txt"])


def test_a_filter_on_a_stream_and_a_first_time(spark, folder, tmp_path):
    later = max((folder / n).stat().st_ctime_ns for n in ("a.txt", "b.MD"))
    time.sleep(0.1)
    (folder / "late.txt").write_text("x")
    time.sleep(0.2)
    stream = spark.readStream.format("skerry_files").option("settle_seconds", "0.05").option("from_ns", str(later)).load(str(folder)).where(F.col("suffix") == ".txt")
    q = stream.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert "late.txt" in names(spark.table("late")) and "a.txt" not in names(spark.table("late"))
