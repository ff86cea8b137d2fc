"""Helpers shared by the corpus operators: reading, scratch tables, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one numpy pass handles; bounds a worker's temporaries.
CHUNK_BYTES = 2_000_000
#: Bytes of a table, as Spark estimates it, to a partition of what is made of it.
PARTITION_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a whole URI:
    ``spark.checkpoint.dir``, or, where it is unset, a folder of our own, which
    only a session whose executors are on this machine may have."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folders.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="skerry-")
        _own_folders[context.applicationId] = base
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage in a
    way that survives lost executors, and evaluates ``df`` once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """How many partitions a shuffle of rows made of ``df`` gets: the session's
    number, or more where Spark's estimate of ``df`` asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # without statistics Spark takes a table for endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` (string or binary) has about ``limit``
    bytes in each; a single longer value stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def columns(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def with_columns(df: DataFrame, added: StructType, reads: Iterable[str], make: Callable[..., Iterable[pa.Array]]) -> DataFrame:
    """``df`` with the columns ``added``, which ``make`` gives for the columns ``reads`` of a
    slice; the first of these, a text, bounds the slice.  Columns of ``df`` that have the
    name of an added one, in any case, are replaced.  All pass under names made here, since
    Spark's Arrow functions take no column whose name holds a backtick."""
    fields, reads = df.schema.fields, list(reads)
    taken = {f.name.lower() for f in added}
    kept = [i for i, f in enumerate(fields) if f.name.lower() not in taken]
    at = [f"c{next(i for i, f in enumerate(fields) if f.name == r)}" for r in reads]
    names = [*(f"c{i}" for i in kept), *(f"n{i}" for i in range(len(added)))]
    types = [*(fields[i].dataType for i in kept), *(f.dataType for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at[0]):
            yield pa.RecordBatch.from_arrays([*(b.column(f"c{i}") for i in kept), *make(*(b.column(a) for a in at))], names)

    mapped = df.toDF(*(f"c{i}" for i in range(len(fields)))).mapInArrow(run, StructType([StructField(n, t) for n, t in zip(names, types, strict=True)]))
    return mapped.toDF(*(fields[i].name for i in kept), *(f.name for f in added))


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of sorted rows in which no group of ``key`` is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
