"""Units of file content kept by content hash, so that a file is read again only
where its path, time and size are new, and parsed again only where its bytes are.

Four Parquet tables under one folder that all executors share, only ever added to:
``hashes`` (path, mtime_ns, size_bytes, content_hash), ``entries`` (kind,
variant, content_hash, size_bytes), ``units`` and ``uses`` (when, which entries).
``evict`` writes what stays as the next generation, a new set of folders."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, extract

_SCHEMAS = {
    "hashes": "path string, mtime_ns long, size_bytes long, content_hash string",
    "entries": "kind string, variant string, content_hash string, size_bytes long",
    "units": "kind string, variant string, content_hash string, unit_ord int, line_number int, text string, location_kind string",
    "uses": "kind string, variant string, content_hash string, used_at double",
    "generations": "n int",
}
#: Bins of times in which the cache's size is summed up.
BINS = 1_000
KEY = ["kind", "variant", "content_hash"]
_PLACE = ["path", "mtime_ns", "size_bytes"]


def _digest(content: bytes) -> str:
    return hashlib.blake2b(content, digest_size=32).hexdigest()


def oldest_that_stays(dated: DataFrame, max_bytes: int, bins: int = BINS) -> float:
    """The earliest ``used_at`` from which on all size_bytes are ``max_bytes`` at most;
    infinity if not even the last time's are.  Times are summed up in bins, and again within
    the bin that goes over, until that is one time: no rows are sorted, and what reaches
    the driver is a row a bin."""
    stays, kept = float("inf"), 0
    low, high = dated.agg(F.min("used_at"), F.max("used_at")).first()
    while low is not None:
        width = (high - low) / bins or 1.0
        own = dated.where((F.col("used_at") >= low) & (F.col("used_at") <= high))
        sums = own.groupBy(F.floor((F.col("used_at") - low) / width).alias("bin")).agg(F.sum("size_bytes").alias("bytes"), F.min("used_at").alias("low"), F.max("used_at").alias("high"))
        over = None
        for r in sorted(sums.collect(), key=lambda r: -r["bin"]):
            if kept + r["bytes"] > max_bytes:
                over = r
                break
            kept, stays = kept + r["bytes"], r["low"]
        if over is None or over["low"] == over["high"]:
            return stays
        low, high = over["low"], over["high"]
    return stays


class UnitCache:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.generation = self._read("generations", "").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def _at(self, table: str, generation: int | str | None = None) -> str:
        g = self.generation if generation is None else generation
        return f"{self.folder}/{table}" if g == "" else f"{self.folder}/g{g}/{table}"

    def _read(self, table: str, generation: int | str | None = None) -> DataFrame:
        where = self._at(table, generation)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).parquet(where)

    def _add(self, rows: DataFrame, table: str, generation: int | str | None = None) -> None:
        rows.write.mode("append").parquet(self._at(table, generation))

    def hashed(self, files: DataFrame) -> DataFrame:
        """``files`` with content_hash; only files that are new or changed are read."""
        fresh = files.join(self._read("hashes"), _PLACE, "left_anti").select(*_PLACE, "archive", "member")

        def told(rows: list[dict], sums: list[str]) -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in rows], pa.string() if c == "path" else pa.int64()) for c in _PLACE]
            return pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.string())], [*_PLACE, "content_hash"])

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.select(_PLACE).to_pylist()
                yield told(rows, [_digest(extract._read(r["path"])) for r in rows])

        def of_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, content in archives.each(batches):
                yield told([row], [_digest(content)])

        found = fresh.where(F.col("archive").isNull()).mapInArrow(own, _SCHEMAS["hashes"])
        members = archives.grouped(fresh.where(F.col("archive").isNotNull())).mapInArrow(of_archives, _SCHEMAS["hashes"])
        self._add(found.unionByName(members), "hashes")
        return files.join(self._read("hashes").dropDuplicates(_PLACE), _PLACE)

    def units(self, files: DataFrame, ports: extract.Ports | dict[str, Callable] | None = None, variant: str = "", want: extract.Wanted = extract.Wanted()) -> DataFrame:
        """As ``extract.units``.  Name another ``variant`` where the readers differ;
        which surfaces are read is part of it.
        Extended attributes are kept as they were when the content was first read."""
        named = self.hashed(files.where(~F.col("names_only"))).withColumns({"kind": F.coalesce(F.when(F.col("archive").isNotNull(), "member"), "suffix"), "variant": F.lit(f"{variant}/{want}")})
        # one file for each content that is new
        misses = named.join(self._read("entries"), KEY, "left_anti")
        one = misses.groupBy(*KEY).agg(F.min_by(F.struct(*(c for c in named.columns if c not in KEY)), "path").alias("f")).select(*KEY, "f.*")
        read = extract.units(one, ports, want).join(one.select("file_id", *KEY), "file_id")
        self._add(read.select(*KEY, "unit_ord", "line_number", "text", "location_kind"), "units")
        self._add(one.select(*KEY, "size_bytes"), "entries")
        used = named.select(*KEY).distinct().withColumn("used_at", F.lit(time.time()))
        self._add(used, "uses")
        # entries written twice by runs at the same time count once
        kept = self._read("units").dropDuplicates([*KEY, "unit_ord"])
        return named.select("file_id", *KEY).join(kept, KEY).select("file_id", "unit_ord", "line_number", "text", "location_kind")

    def size(self) -> int:
        return self._read("entries").dropDuplicates(KEY).agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]

    def evict(self, max_bytes: int) -> None:
        """Drop what was used longest ago until at most ``max_bytes`` of content are
        left.  Entries of one run share a time and go together."""
        last = self._read("uses").groupBy(*KEY).agg(F.max("used_at").alias("used_at"))
        dated = self._read("entries").dropDuplicates(KEY).join(last, KEY)
        stays = dated.where(F.col("used_at") >= oldest_that_stays(dated, max_bytes))
        following = self.generation + 1
        self._add(self._read("hashes"), "hashes", following)
        self._add(stays.select(*KEY, "size_bytes"), "entries", following)
        self._add(stays.select(*KEY, "used_at"), "uses", following)
        self._add(self._read("units").join(stays, KEY, "left_semi"), "units", following)
        self._add(self.spark.createDataFrame([(following,)], _SCHEMAS["generations"]).coalesce(1), "generations", "")
        self.generation = following
