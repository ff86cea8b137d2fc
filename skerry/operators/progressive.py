"""A file search in parts, so that results are there before the end.

The listing is written once, in parts of files picked by a hash of their path, each as
large as all before it: the first answer takes one file in 64, and there are no more
than PARTS of them whatever the size of the tree.  A part's matches are whole and final
for its files, so that what has been found when a search is cancelled is right.  Where
only the best ``limit`` are wanted, the last of the best so far is a threshold that only
rises: of the parts behind, only what comes before it is written, and each task passes on
no more than ``limit`` of it.  After the last part the best so far is the ranked answer.

Files searched and matches are counted inside the plan of each part, by an observation
of what passes there; no job is run to count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.query import FileQ
from ..sources.files import WalkOptions, list_files
from .file_search import RESULTS, SKIPPED, FileSearch, search_files
from .layout import once

#: Parts, and the least number of files that is worth more than one.
PARTS, LEAST_FILES = 7, 20_000


@dataclass(frozen=True)
class Part:
    """How far a search is: files searched and files in all, matches among them; and this
    part's results that are among the best so far."""

    completed: int
    total: int
    matches: int
    results: DataFrame


def part_of(path: Column, parts: int) -> Column:
    """0 to parts - 1, each of which but the first has as many paths as all before it."""
    bucket = F.pmod(F.xxhash64(path), F.lit(1 << (parts - 1)))
    return F.when(bucket == 0, 0).otherwise(F.floor(F.log2(bucket.cast("double") + 0.5)).cast("int") + 1).cast("int")


def ranked(results: DataFrame, limit: int | None = None) -> DataFrame:
    rows = results.orderBy(F.col("score").desc(), "path")
    return rows.limit(limit) if limit else rows


class ProgressiveSearch:
    """One search; ``run`` may be called once.  ``more`` is what ``search_files`` takes."""

    def __init__(self, spark: SparkSession, root: str, query: str | FileQ, *, limit: int | None = None, options: WalkOptions = WalkOptions(), parts: int | None = None, **more) -> None:
        self.spark, self.root, self.query, self.limit, self.options, self.parts, self.more = spark, root, query, limit, options, parts, more
        self._found: list[DataFrame] = []
        self._skipped: list[DataFrame] = []
        self.completed = self.total = self.matches = 0

    def best(self) -> DataFrame:
        """The ranked answer for the parts that are done."""
        return ranked(reduce(DataFrame.unionByName, self._found), self.limit) if self._found else self.spark.createDataFrame([], RESULTS)

    def skipped(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._skipped) if self._skipped else self.spark.createDataFrame([], SKIPPED)

    def _floor(self) -> tuple[float, str] | None:
        """Score and path of the last of the best so far, if there are ``limit`` of them."""
        if not self.limit or not self._found:
            return None
        last = self.best().agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "path")).alias("last")).first()
        return (-last["last"]["s"], last["last"]["path"]) if last["n"] == self.limit else None

    def run(self, tell: Callable[[Part], None] = lambda part: None, cancelled: Callable[[], bool] = lambda: False) -> FileSearch:
        """Search part by part, until ``cancelled``; ``tell`` is called after each."""
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        listed = once(list_files(self.spark, self.root, self.options).repartition(tasks), "files")
        self.total = listed.count()
        parts = self.parts or (PARTS if self.total >= LEAST_FILES else 1)
        if parts > 1:
            listed = once(listed.withColumn("_part", part_of(F.col("path"), parts)), "parts", by="_part")
        sizes = {r["_part"]: r["count"] for r in listed.groupBy("_part").count().collect()} if parts > 1 else {0: self.total}
        for k in range(parts):
            if cancelled():
                break
            files = listed.where(F.col("_part") == k).drop("_part") if parts > 1 else listed
            if sizes.get(k):
                seen = Observation()
                found = search_files(self.spark, self.root, self.query, options=self.options, files=files, written=True, order=False, **self.more)
                rows, floor = found.results.observe(seen, F.count("*").alias("matches")), self._floor()
                if floor:
                    score, path = F.col("score"), F.col("path")
                    rows = rows.where((score > floor[0]) | ((score == floor[0]) & (path < floor[1])))
                stored = once(ranked(rows, self.limit) if self.limit else rows, "results")
                self._found.append(stored)
                self._skipped.append(found.skipped)
                self.completed += sizes[k]
                self.matches += seen.get["matches"]
                tell(Part(self.completed, self.total, self.matches, ranked(stored)))
        return FileSearch(self.best(), self.skipped())
