"""Where rows lie: small tables dealt out to all cores, results written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Up to so many bytes, as Spark estimates them, a table is dealt out again.
SMALL_BYTES = 256 << 20
#: Up to so many rows a listing of files is kept by the driver in place of a table.
FEW_ROWS = 5_000

_own_folders: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores, if it is so small that it may lie in one file part, which
    one task reads.  A large table stays as it is read: it has parts enough."""
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``, or, where executors are on this machine, a folder of
    our own; None where there is no folder that all of them share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        name = spark.sparkContext.applicationId
        base = _own_folders[name] = _own_folders.get(name) or tempfile.mkdtemp(prefix="skerry-")
    return base.rstrip("/") if base else None


def once(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so that two uses do not make
    it twice and a lost executor costs a read; as it is where there is no such folder.
    by: a column whose values get folders of their own."""
    base = shared_folder(df.sparkSession)
    if base is None:
        return df
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_or_once(df: DataFrame, tasks: int, label: str) -> DataFrame:
    """Rows that are made once and dealt out to ``tasks``: those of a small ``df`` as they
    are, FEW_ROWS at most, others written to the shared folder."""
    rows = df.limit(FEW_ROWS + 1).toArrow()
    if rows.num_rows <= FEW_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema)
    return once(df.repartition(tasks), label)
