"""The files below a folder as a DataFrame, archive members included.

The driver finds folders level by level until there are enough of them to share
out; tasks list their files and walk the rest.  Executors must see the folder under the same path."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives

# Names that are no content of a user's.
NOISE_FOLDERS = ("__pycache__", "node_modules")
PSEUDO_FOLDERS = ("proc", "sys", "dev", "run")
NOISE_NAMES = (
    "thumbs.db", "ehthumbs.db", "desktop.ini", "uv.lock", "poetry.lock", "pipfile.lock", "pdm.lock", "cargo.lock", "gemfile.lock",
    "composer.lock", "bun.lock", "bun.lockb", "flake.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "go.sum",
)
NOISE_PATTERNS = (
    "*.lock", "*-lock.json", "*-lock.yaml", "*-lock.yml", "*.min.js", "*.min.css", "*.js.map", "*.css.map", "*.mjs.map", "*.cjs.map", "*.ts.map",
    "~$*", "*.tmp", "*.temp", "*.bak", "*.wbk", "*.xlk", "*.asd", "*.laccdb", "*.crdownload", "*.part",
)
_NOISE_FILE = "^(?:" + "|".join([*map(re.escape, NOISE_NAMES), *(".*".join(map(re.escape, p.split("*"))) for p in NOISE_PATTERNS)]) + ")$"

#: Folders that the driver finds before it shares them out, and rows to a batch.
SEEDS, BATCH = 256, 10_000
FILES = "path string, rel_path string, size_bytes long, mtime_ns long"
_SCHEMA = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64())])


@dataclass(frozen=True)
class WalkOptions:
    skip_hidden_folders: bool = True
    skip_noise_folders: bool = True
    skip_noise_files: bool = True
    match_skipped_names: bool = False
    include_archives: bool = False
    include_subdirectories: bool = True


def _hidden(part: Column) -> Column:
    return part.startswith(".")


def _enter(folder: str, name: str, o: WalkOptions) -> bool:
    if folder == os.sep and name in PSEUDO_FOLDERS:
        return False
    if o.match_skipped_names:
        return True
    return not (o.skip_hidden_folders and name.startswith(".")) and not (o.skip_noise_folders and name in NOISE_FOLDERS)


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What is in a folder; nothing of one that cannot be read."""
    try:
        with os.scandir(folder) as found:
            yield from found
    except OSError:
        return


def _folders(folder: str, o: WalkOptions) -> list[str]:
    """Folders in a folder that are entered; linked ones are not."""
    return sorted(e.path for e in _entries(folder) if o.include_subdirectories and e.is_dir(follow_symlinks=False) and _enter(folder, e.name, o))


def _files(folder: str, root: str) -> Iterator[dict]:
    for e in _entries(folder):
        try:
            if not e.is_dir(follow_symlinks=False) and stat.S_ISREG((s := e.stat()).st_mode):
                yield {"path": e.path, "rel_path": os.path.relpath(e.path, root).replace(os.sep, "/"), "size_bytes": s.st_size, "mtime_ns": s.st_mtime_ns}
        except OSError:  # what cannot be read is passed over
            continue


def _seeds(root: str, o: WalkOptions) -> list[tuple[str, bool]]:
    """(folder, whether what is below it is not listed here): the driver looks for
    folders alone, until there are SEEDS of them or SEEDS have been looked into."""
    done, level = [], [root]
    while level and len(level) + len(done) < SEEDS:
        done += level
        level = [x for f in level for x in _folders(f, o)]
    return [(f, False) for f in done] + [(f, True) for f in level]


def _listed(spark: SparkSession, root: str, o: WalkOptions) -> DataFrame:
    """All files, listed by tasks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, below in zip(b.column("folder").to_pylist(), b.column("below").to_pylist(), strict=True):
                stack = [folder]
                while stack:
                    now = stack.pop()
                    stack += _folders(now, o) if below else []
                    held = []
                    for f in _files(now, root):
                        held.append(f)
                        if len(held) == BATCH:
                            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    seeds = _seeds(root, o)
    rows = spark.createDataFrame(seeds, "folder string, below boolean")
    return rows.repartition(min(len(seeds), spark.sparkContext.defaultParallelism * 4)).mapInArrow(walk, FILES)


def skipped(rel_path: Column, o: WalkOptions) -> Column:
    """Whether the options skip a file by the names on its path."""
    parts = F.split(rel_path, "/")
    out = F.lit(False)
    if o.skip_hidden_folders:
        out = out | F.exists(parts, _hidden)
    if o.skip_noise_folders:
        out = out | F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, NOISE_FOLDERS)))
    if o.skip_noise_files:
        out = out | F.lower(F.element_at(parts, -1)).rlike(_NOISE_FILE)
    return out


def suffix(name: Column) -> Column:
    """The last suffix of a name, in lower case; empty where it has none."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def list_files(spark: SparkSession, root: str, options: WalkOptions = WalkOptions()) -> DataFrame:
    """file_id, path, name, rel_path, suffix, size_bytes, mtime_ns, names_only, archive,
    member.  A root that is a file is returned untested and unexpanded."""
    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    o, single = options, os.path.isfile(root)
    if single:
        s = os.stat(root)
        rows = spark.createDataFrame([(root, os.path.basename(root), s.st_size, s.st_mtime_ns)], FILES)
    else:
        rows = _listed(spark, root, o)
    rows = rows.withColumn("names_only", F.lit(False) if single else skipped(F.col("rel_path"), o))
    if not o.match_skipped_names:
        rows = rows.where(~F.col("names_only"))
    rows = rows.select("*", F.lit(None).cast("string").alias("archive"), F.lit(None).cast("string").alias("member"))
    if o.include_archives and not single:
        rows = rows.unionByName(archives.members(rows.where(F.lower("path").rlike(archives.ARCHIVE) & ~F.col("names_only"))))
    base = F.coalesce("member", "rel_path")
    return rows.withColumns({"file_id": F.xxhash64("path"), "name": F.element_at(F.split(base, "/"), -1)}).withColumn("suffix", suffix(F.col("name")))
