"""The files below a folder as a data source, for ``spark.read`` and ``spark.readStream``.

    register(spark)
    spark.read.format("skerry_files").option("skip_hidden_folders", "false").load("/data")
    spark.readStream.format("skerry_files").load("/data")

Options are those of ``WalkOptions`` by name; ``under`` (a beginning of ``rel_path``),
``suffixes`` (with commas between), ``min_bytes`` and ``max_bytes``; ``partitions`` (64); and
for streams ``settle_seconds`` (1) and ``from_ns`` (0).

Reading: the reader shares folders out; tasks list them.  What is asked of the beginning
of ``rel_path`` leaves out folders, whole partitions among them, before anything is
listed; what is asked of names is tested before a file's size is asked for, and what is
asked of numbers before a row is made.  It is asked by options, or by the filters of a
query, which Spark hands over where the option ``push`` is true.  Spark 4.1 then keeps a
query's filters for later queries on the same DataFrame, which would find too little:
load anew for each query, or use the other options.

Streaming: the offset is a time, and a micro-batch has the files that changed, or were
moved here, after the last one's offset and up to its own: by the later of content time
and inode time, so that a file that comes with an old date is new all the same.  A
file that changes again is listed again.  Files younger than ``settle_seconds`` are left
to the next micro-batch, so that what is listed can be read and clocks may differ by so
much; no micro-batch lists another's files, run again or not.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from .files import _NOISE_FILE, BATCH, NOISE_FOLDERS, WalkOptions, _entries, _folders, _seeds

SCHEMA = "path string, rel_path string, name string, suffix string, size_bytes long, mtime_ns long, changed_ns long, names_only boolean"
_ARROW = pa.schema([
    ("path", pa.string()), ("rel_path", pa.string()), ("name", pa.string()), ("suffix", pa.string()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()),
    ("changed_ns", pa.int64()), ("names_only", pa.bool_()),
])
PARTITIONS, SETTLE_SECONDS = 64, 1.0

_NAMES, _NUMBERS = ("path", "rel_path", "name", "suffix"), ("size_bytes", "mtime_ns", "changed_ns")
_COMPARE: dict[type, Callable] = {
    GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b,
}
Test = tuple[str, str, object]


def _test(f: Filter) -> Test | None:
    """(column, kind, value) of a filter that the walk can make itself."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column, value = f.attribute[0], getattr(f, "value", None)
    if column in _NUMBERS and type(f) in _COMPARE:
        return column, type(f).__name__, value
    if column in _NAMES:
        kinds = {EqualTo: "is", StringStartsWith: "starts", StringEndsWith: "ends"}
        if type(f) in kinds:
            return column, kinds[type(f)], value
        if isinstance(f, In):
            return column, "in", frozenset(value)
    return None


def _passes(test: Test, row: dict) -> bool:
    column, kind, value = test
    x = row[column]
    if kind in ("is", "in", "starts", "ends"):
        return x == value if kind == "is" else x in value if kind == "in" else x.startswith(value) if kind == "starts" else x.endswith(value)
    return next(c for t, c in _COMPARE.items() if t.__name__ == kind)(x, value)


def suffix_of(name: str) -> str:
    found = re.search(r"[^.](\.[^.]+)$", name)
    return found[1].lower() if found else ""


def is_skipped(rel_path: str, o: WalkOptions) -> bool:
    """Whether the options skip a file by the names on its path; as ``files.skipped``."""
    parts = rel_path.split("/")
    return (
        (o.skip_hidden_folders and any(p.startswith(".") for p in parts))
        or (o.skip_noise_folders and any(p in NOISE_FOLDERS for p in parts[:-1]))
        or (o.skip_noise_files and re.search(_NOISE_FILE, parts[-1].lower()) is not None)
    )


@dataclass(frozen=True)
class Walk:
    """What one run lists: below which folder, by which options and tests, and, on a
    stream, which changes."""

    root: str
    options: WalkOptions
    tests: tuple[Test, ...] = ()
    after: int | None = None
    until: int | None = None

    def folder_may_hold(self, folder: str) -> bool:
        """Whether the beginnings asked for leave a folder any files."""
        own = self._relative(folder)
        own = "" if own == "." else own + "/"
        starts = [v for c, kind, v in self.tests if c == "rel_path" and kind in ("starts", "is")]
        return all(own.startswith(v) or v.startswith(own) for v in starts)

    def _relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def rows(self, folder: str) -> Iterator[dict]:
        """Files of one folder."""
        by_name = [t for t in self.tests if t[0] in _NAMES]
        by_number = [t for t in self.tests if t[0] in _NUMBERS]
        for e in _entries(folder):
            try:
                if e.is_dir(follow_symlinks=False) or not e.is_file():
                    continue
                row = {"path": e.path, "rel_path": self._relative(e.path), "name": e.name, "suffix": suffix_of(e.name)}
                row["names_only"] = is_skipped(row["rel_path"], self.options)
                if (row["names_only"] and not self.options.match_skipped_names) or not all(_passes(t, row) for t in by_name):
                    continue
                s = e.stat()
                row |= {"size_bytes": s.st_size, "mtime_ns": s.st_mtime_ns, "changed_ns": max(s.st_mtime_ns, s.st_ctime_ns)}
                if self.after is not None and not self.after < row["changed_ns"] <= self.until:
                    continue
                if all(_passes(t, row) for t in by_number):
                    yield row
            except OSError:  # what cannot be read is passed over
                continue

    def partitions(self, n: int) -> list[Folders]:
        """Folders shared out to at most ``n`` tasks: those that the driver finds, each
        with what is below it or without."""
        if os.path.isfile(self.root):
            raise NotADirectoryError(self.root)
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        seeds = [s for s in _seeds(self.root, self.options) if self.folder_may_hold(s[0])]
        return [Folders(seeds[k::n]) for k in range(min(n, len(seeds)))]

    def read(self, seeds: Sequence[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for folder, below in seeds:
            stack = [folder]
            while stack:
                now = stack.pop()
                stack += [f for f in _folders(now, self.options) if self.folder_may_hold(f)] if below else []
                for row in self.rows(now):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


class Folders(InputPartition):
    def __init__(self, seeds: Sequence[tuple[str, bool]]) -> None:
        self.seeds = list(seeds)


class _Reader(DataSourceReader):
    def __init__(self, walk: Walk, n: int) -> None:
        self.walk, self.n = walk, n

    def partitions(self) -> Sequence[InputPartition]:
        return self.walk.partitions(self.n)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        yield from self.walk.read(partition.seeds)


class _Pushed(_Reader):
    """A reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.walk = replace(self.walk, tests=(*self.walk.tests, test))


class _Stream(DataSourceStreamReader):
    def __init__(self, walk: Walk, n: int, settle: float, first: int) -> None:
        self.walk, self.n, self.settle, self.first = walk, n, int(settle * 1e9), first

    def initialOffset(self) -> dict:
        return {"changed_ns": self.first}

    def latestOffset(self) -> dict:
        return {"changed_ns": max(time.time_ns() - self.settle, self.first)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = self.walk.partitions(self.n)
        for p in found:
            p.after, p.until = start["changed_ns"], end["changed_ns"]
        return found

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        yield from replace(self.walk, after=partition.after, until=partition.until).read(partition.seeds)

    def commit(self, end: dict) -> None:
        return


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skerry_files"

    def schema(self) -> str:
        return SCHEMA

    def _walk(self) -> Walk:
        given = {f.name: self.options.get(f.name) for f in fields(WalkOptions)}
        options = WalkOptions(**{k: v.lower() == "true" for k, v in given.items() if v is not None and k != "include_archives"})
        path = self.options.get("path")
        if not path:
            raise ValueError("give the folder: load(folder)")
        asked: list[Test] = []
        if self.options.get("under"):
            asked.append(("rel_path", "starts", self.options["under"]))
        if self.options.get("suffixes"):
            asked.append(("suffix", "in", frozenset(x.strip().lower() for x in self.options["suffixes"].split(","))))
        for name, kind in (("min_bytes", GreaterThanOrEqual), ("max_bytes", LessThanOrEqual)):
            if self.options.get(name):
                asked.append(("size_bytes", kind.__name__, int(self.options[name])))
        return Walk(os.path.abspath(path.removeprefix("file:")), options, tuple(asked))

    def _n(self) -> int:
        return max(1, int(self.options.get("partitions") or PARTITIONS))

    def reader(self, schema) -> DataSourceReader:
        return (_Pushed if self.options.get("push", "").lower() == "true" else _Reader)(self._walk(), self._n())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._walk(), self._n(), float(self.options.get("settle_seconds") or SETTLE_SECONDS), int(self.options.get("from_ns") or 0))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which may then hand filters over to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
