"""Members of archives: listing under limits, and reading them.

An archive that is a stream, a tar or a plain gzip file, is read forward once for all
of its members; a zip's members are read where its directory says they lie, so that a
large one is shared out by ranges of them.
"""

from __future__ import annotations

import gzip
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
ARCHIVE = r"\.(zip|tar|tar\.gz|tar\.bz2|tar\.xz|tgz|tbz2|txz|gz)$"
MAX_ENTRIES, MAX_BYTES = 10_000, 200 * 1024 * 1024
MARK = "::"
#: Bytes of a zip's members that one task reads, about.
RANGE_BYTES = 32 << 20
_TAR = (".tar", ".tar.gz", ".tar.bz2", ".tar.xz", ".tgz", ".tbz2", ".txz")
_ERRORS = (OSError, EOFError, ValueError, RuntimeError, NotImplementedError, zipfile.BadZipFile, tarfile.TarError)


def entries(path: str) -> list[tuple[str, int]]:
    """(member, size) of the files in an archive; none of one that is broken or
    over a limit.  A plain gzip file has one member, its name without the suffix."""
    low, found, total = path.lower(), [], 0
    try:
        if low.endswith(".zip"):
            with zipfile.ZipFile(path) as z:
                listed = ((i.filename, i.file_size) for i in z.infolist() if not i.is_dir())
                found = list(listed)
        elif low.endswith(_TAR):
            with tarfile.open(path) as t:
                for m in t:
                    if m.isfile():
                        found.append((m.name, m.size))
                        total += m.size
                    if len(found) > MAX_ENTRIES or total > MAX_BYTES:
                        return []
        else:
            found = [(os.path.basename(path)[:-3], _gzip_size(path))]
    except _ERRORS:
        return []
    return found if len(found) <= MAX_ENTRIES and sum(n for _, n in found) <= MAX_BYTES else []


def _gzip_size(path: str) -> int:
    size = 0
    with gzip.open(path) as f:
        while size <= MAX_BYTES and (block := f.read(1 << 20)):
            size += len(block)
    return size


def contents(path: str, wanted: dict[str, int]) -> Iterator[tuple[str, bytes]]:
    """(member, content) of the wanted members, in their order; ``wanted`` says how often
    each name is listed, and the last of its members counts.  A stream is decompressed
    once, up to the last member that is wanted; a fault ends it, and what comes before
    the fault is given."""
    low = path.lower()
    try:
        if low.endswith(".zip"):
            with zipfile.ZipFile(path) as z:
                for i in sorted((z.getinfo(m) for m in wanted if m in z.NameToInfo), key=lambda i: i.header_offset):
                    try:
                        yield i.filename, z.read(i)
                    except _ERRORS:
                        continue
        elif low.endswith(_TAR):
            left = dict(wanted)
            with _opened(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as t:
                for m in t:
                    if m.isfile() and m.name in left:
                        left[m.name] -= 1
                        if left[m.name] <= 0:
                            del left[m.name]
                            yield m.name, t.extractfile(m).read()
                        if not left:
                            return
        elif wanted:
            with _opened(path) as raw, gzip.open(raw) as f:
                yield os.path.basename(path)[:-3], f.read(MAX_BYTES)
    except _ERRORS:
        return


def grouped(members: DataFrame) -> DataFrame:
    """(archive, part, found): the rows of ``members`` by archive, a zip's by ranges of
    about RANGE_BYTES of its directory.  An archive has MAX_ENTRIES rows at most."""
    before = F.sum("size_bytes").over(Window.partitionBy("archive").orderBy("member", "path").rowsBetween(Window.unboundedPreceding, -1))
    part = F.when(F.lower("archive").endswith(".zip"), F.floor(F.coalesce(before, F.lit(0)) / RANGE_BYTES)).otherwise(0).cast("int")
    rows = members.select(F.struct(*members.columns).alias("row"), "archive", part.alias("part"))
    # what the window dealt out by archive is dealt out again, so that tasks share a large zip
    return rows.repartition("archive", "part").groupBy("archive", "part").agg(F.collect_list("row").alias("found"))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """(row, content) of each member of ``grouped`` rows; nothing of those that cannot be read."""
    for b in batches:
        for archive, found in zip(b.column("archive").to_pylist(), b.column("found").to_pylist(), strict=True):
            rows: dict[str, list[dict]] = {}
            for row in found:
                rows.setdefault(row["member"], []).append(row)
            for member, content in contents(archive, {m: len(r) for m, r in rows.items()}):
                yield from ((row, content) for row in rows[member])


def _opened(path: str):
    """The bytes of an archive; tests count them here."""
    return open(path, "rb")


def members(files: DataFrame) -> DataFrame:
    """A row for each member, with the columns of ``files``; path is archive::member."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = [row | {"path": row["path"] + MARK + m, "rel_path": row["rel_path"] + MARK + m, "size_bytes": n, "archive": row["path"], "member": m} for m, n in entries(row["path"])]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return files.mapInArrow(expand, files.schema)
