"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``tree_500`` is a folder of 500 files of 40 lines of 8 to 16 words, a needle in the
first five, searched by content with all matchers but semantic; ``l_default`` scores
the lines of all documents with these matchers."""

from __future__ import annotations

import json
import os
import random
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from skerry import registry
from skerry.operators import units
from skerry.operators.file_search import search_files
from skerry.plans.query import parse_file_query

#: Row-returning queries that touch the whole of a table.
HEADLINE = ("m_contains", "c_native", "q_nested", "s_topk", "m_semantic", "m_fuzzy", "magic_search", "u_tokens", "l_top_lines", "file_and_or", "u_best_token", "k_ratio")


WORDS = (
    "amber basin candle delta engine forest garden harbor island jungle kettle lantern meadow needlework ocean pepper quartz river saddle timber umbrella valley window "
    "yellow zephyr anchor bridge copper desert ember falcon glacier hollow ivory jacket kernel ladder marble nectar orchard"
).split()
NEEDLE = "skerry_needle"


def make_tree(folder: Path, n: int = 500) -> Path:
    r = random.Random(42)
    for i in range(n):
        lines = [f"In this file is the token {NEEDLE} to be found."] * (i < 5)
        lines += [" ".join(r.choices(WORDS, k=r.randint(8, 16))) for _ in range(40)]
        (folder / f"file_{i:04d}.txt").write_text("\n".join(lines))
    return folder


def tree_500(spark: SparkSession, sf_dir: str):
    return search_files(spark, tree_500.folder, NEEDLE, names=False).results


def l_default(spark: SparkSession, sf_dir: str):
    rows = units.lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return units.score_units(rows, parse_file_query("worthless"))


def main() -> None:
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    tree_500.folder = str(make_tree(Path(tempfile.mkdtemp(prefix="skerry-bench-"))))
    for name, run in [*((n, registry.QUERIES[n]) for n in HEADLINE), ("tree_500", tree_500), ("l_default", l_default)]:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
