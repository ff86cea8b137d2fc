"""The best results so far of a stream, kept up as results arrive.

Results of a group (a query, say) with one key (a path) are one result, the best of
them.  Each group is kept in SHARDS shards by key, and a shard's state is its best
``limit`` results and no more: what falls out of them is under ``limit`` better ones for
good, since a key's score only rises, and so is never asked for again.  A shard that
changed in a micro-batch is written whole, under the batch's number, so that a batch
that runs again writes the same rows in place of the old; the answer is the best
``limit`` of the shards' last lists.  Equal scores are ordered by key, so that the answer
is that of a sort of the whole table, however the stream is cut.

State is in the RocksDB store, as ``transformWithStateInPandas`` asks; its checkpoint
lies with the shards, and a run called again goes on from it.

A null group is a group, a null key is a key, and results with a null or NaN score count for nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

SHARDS = 64
STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "best string"


class _Best(StatefulProcessor):
    """Best results of one shard: [[negated score, key, row]], sorted, at most ``limit``."""

    def __init__(self, limit: int, columns: list[str]) -> None:
        self.limit, self.columns = limit, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = {k: (s, row) for s, k, row in json.loads(self.state.get()[0])} if self.state.exists() else {}
        worst, changed = self._worst(held), False
        for part in rows:
            for k, score, row in zip(part["name"], part["points"], part["row"], strict=True):
                k = None if pd.isna(k) else k
                place = -score, k is not None, k or ""
                if (k in held and held[k][0] <= -score) or (worst is not None and place > worst):
                    continue
                held[k] = -score, row
                changed = True
                if len(held) > 2 * self.limit:
                    held = self._cut(held)
                    worst = self._worst(held)
        if not changed:
            return
        held = self._cut(held)
        self.state.update((json.dumps([[s, k, row] for k, (s, row) in held.items()]),))
        out = [(*key, rank, row) for rank, (_, row) in enumerate(held.values(), 1)]
        yield pd.DataFrame(out, columns=["of", "shard", "place", "row"])

    @staticmethod
    def _place(item: tuple) -> tuple:
        return item[1][0], item[0] is not None, item[0] or ""

    def _worst(self, held: dict) -> tuple | None:
        return max(map(self._place, held.items())) if len(held) >= self.limit else None

    def _cut(self, held: dict) -> dict:
        return dict(sorted(held.items(), key=self._place)[: self.limit])

    def close(self) -> None:
        pass


def shards(stream: DataFrame, limit: int, key: str, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """The shards that change, in update mode: (of, shard, place, row), a shard's
    whole list of JSON rows each time."""
    if limit < 1:
        raise ValueError("limit is the number of results to keep, 1 or more")
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in stream.columns)), {"ignoreNullFields": "false"})
    name = F.col(f"`{key}`").cast("string")
    group = F.to_json(F.struct(*(F.col(f"`{g}`") for g in groups)), {"ignoreNullFields": "false"}) if groups else F.lit("")
    points = F.col(f"`{score}`").cast("double")
    rows = stream.where(points.isNotNull() & ~F.isnan(points)).select(
        group.alias("of"), F.pmod(F.xxhash64(name), F.lit(SHARDS)).cast("int").alias("shard"), name.alias("name"), points.alias("points"), whole.alias("row")
    )
    return rows.groupBy("of", "shard").transformWithStateInPandas(
        statefulProcessor=_Best(limit, stream.columns), outputStructType="of string, shard int, place int, row string", outputMode="Update", timeMode="None"
    )


class BestSoFar:
    """Best results of a stream, below a folder that driver and executors share."""

    def __init__(self, folder: str, schema, limit: int, key: str, score: str = "score", groups: Sequence[str] = ()) -> None:
        self.folder, self.schema, self.limit = folder.rstrip("/"), schema, limit
        self.key, self.score, self.groups = key, score, list(groups)

    def _write(self, changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.folder}/shards/_batch={batch}")

    def start(self, stream: DataFrame, trigger: dict | None = None):
        """The running query; by default it ends when it has read what is there now."""
        spark = stream.sparkSession
        changed = shards(stream.select(*(F.col(f"`{f}`") for f in self.schema.names)), self.limit, self.key, self.score, self.groups)
        writer = changed.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/progress").foreachBatch(self._write)
        writer = writer.trigger(**(trigger or {"availableNow": True}))
        before = spark.conf.get(STORE, None)
        spark.conf.set(STORE, PROVIDER)  # a query keeps the settings that it starts with
        try:
            return writer.start()
        finally:
            if before is None:
                spark.conf.unset(STORE)
            else:
                spark.conf.set(STORE, before)

    def now(self, spark: SparkSession) -> DataFrame:
        """The best results of what has arrived, best first within groups, with ``rank``.
        At most ``limit`` rows of SHARDS shards of a group meet here."""
        where = f"{self.folder}/shards"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        names = [f"`{n}`" for n in self.schema.names]
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return spark.createDataFrame([], self.schema).withColumn("rank", F.lit(None).cast("int"))
        lists = spark.read.schema("of string, shard int, place int, row string, _batch long").option("basePath", where).parquet(f"{where}/*")
        last = lists.groupBy("of", "shard").agg(F.max("_batch").alias("_batch"))
        rows = lists.join(last, ["of", "shard", "_batch"]).select("of", F.from_json("row", self.schema).alias("_r"))
        order = [F.col(f"_r.`{self.score}`").cast("double").desc(), F.col(f"_r.`{self.key}`").cast("string").asc_nulls_first()]
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(*order))).where(F.col("rank") <= self.limit)
        return ranked.select(*(F.col(f"_r.{n}") for n in names), "rank")


def best_of(rows: DataFrame, limit: int, key: str, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """The same answer for a table: one result for each key, the best, and of each group
    the first ``limit`` with ``rank``."""
    names, points = [f"`{g}`" for g in groups], F.col(f"`{score}`").cast("double")
    one = Window.partitionBy(*names, f"`{key}`").orderBy(points.desc())
    all_ = Window.partitionBy(*names).orderBy(points.desc(), F.col(f"`{key}`").cast("string").asc_nulls_first())
    rows = rows.where(points.isNotNull() & ~F.isnan(points)).withColumn("rank", F.row_number().over(one)).where("rank = 1")
    return rows.withColumn("rank", F.row_number().over(all_)).where(F.col("rank") <= limit)
