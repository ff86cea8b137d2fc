"""Searches by plain calls: items or a folder in, lists of results out.

For tables use ``operators.records.search``, and for results as a table
``operators.file_search.search_files``; these calls bring the results to the driver."""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from .operators import records, session
from .operators.file_search import Pictures
from .operators.progressive import ProgressiveSearch
from .operators.units import PREVIEW_THRESHOLD, THRESHOLD, TRANSCRIPT_THRESHOLD
from .plans.query import FieldConfig, FileQ, Q
from .sources.extract import Ports
from .sources.files import WalkOptions


@dataclass(frozen=True)
class ActivityUpdate:
    label: str
    current: int | None = None
    total: int | None = None

    @property
    def determinate(self) -> bool:
        return self.current is not None and bool(self.total)


@dataclass
class SearchResult:
    item: Any
    score: float
    breakdown: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class LineMatch:
    line_number: int
    text: str
    score: float
    location_kind: str = "line"
    matched_term: str | None = None


@dataclass
class FileSearchResult:
    path: str
    score: float
    breakdown: dict[str, float] = field(default_factory=dict)
    lines: list[LineMatch] = field(default_factory=list)
    term_surfaces: dict[str, dict[str, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, row: Row) -> FileSearchResult:
        r = row.asDict(recursive=True)
        return cls(r["path"], r["score"], r["breakdown"], [LineMatch(**x) for x in r["lines"]], r["term_surfaces"])


@dataclass(frozen=True)
class SkippedFile:
    path: str
    size_bytes: int
    reason: str = "oversized"


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.appName("skerry").getOrCreate()


def _names(item: Any) -> list[str]:
    """Public fields of a mapping, a dataclass or another object."""
    if isinstance(item, Mapping):
        found = item.keys()
    elif dataclasses.is_dataclass(item):
        found = (f.name for f in dataclasses.fields(item))
    else:
        found = vars(item) if hasattr(item, "__dict__") else ()
    return [n for n in found if isinstance(n, str) and not n.startswith("_")]


def _value(item: Any, name: str) -> Any:
    if isinstance(item, Mapping):
        return item.get(name)
    try:
        return item[name]
    except (TypeError, KeyError, IndexError, AttributeError):
        return getattr(item, name, None)


def _table(spark: SparkSession, items: Sequence[Any], names: list[str]) -> DataFrame:
    """Items as rows of text, with their place."""
    rows = [(i, *(None if (v := _value(x, n)) is None else str(v) for n in names)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, ", ".join(["`_place` int", *(f"`{n}` string" for n in names)]))


def _fields_of(q: Q) -> list[str]:
    return [q.field] if q.op == "LEAF" else [f for c in q.children for f in _fields_of(c)]


def _found(items: Sequence[Any], rows: DataFrame, atomic: set[str]) -> list[SearchResult]:
    why = lambda r: {k: v["score"] if k in atomic else dict(v["parts"]) for k, v in r["breakdown"].items()}
    return [SearchResult(items[r["_place"]], r["score"], why(r)) for r in rows.collect()]


def _atomic(q: Q) -> set[str]:
    """Fields that one matcher explains; a later leaf of a field counts."""
    return {name for name, leaf in records._leaves(q).items() if leaf.match.value != "composite"}


def search(items: Sequence[Any], query: str, *, fields: Sequence[str | FieldConfig] | None = None, where: Q | None = None, threshold: float = 0.0, require_all: bool = False, spark: SparkSession | None = None) -> list[SearchResult]:
    """Items that match, best first, in their order where scores are equal."""
    if (fields is None) == (where is None):
        raise ValueError("give either fields or where")
    if not query.strip() or not items:
        return []
    configs = [records._config(f) for f in fields] if fields is not None else None
    whole = where if where is not None else Q.any(*(Q(c.name, c.match, c.weight, c.composite_weights) for c in configs))
    table = _table(_session(spark), items, sorted(set(_fields_of(whole))))
    rows = records.search(table, query, fields=configs, where=where, threshold=threshold, require_all=require_all, order=["_place"], breakdown=True)
    return _found(items, rows, _atomic(whole)) if "breakdown" in rows.columns else []


def magic_search(items: Sequence[Any], query: str, *, fields: Sequence[str] | None = None, threshold: float = records.MAGIC_THRESHOLD, spark: SparkSession | None = None) -> list[SearchResult]:
    """Items whose best field matches; without ``fields`` all public ones of any item."""
    names = list(fields) if fields else sorted({n for x in items for n in _names(x)})
    return search(items, query, where=Q.any(*(Q.composite(n) for n in names)), threshold=threshold, spark=spark) if names else []


def magic_file_search(
    path: str, query: str | FileQ, *, search_names: bool = True, search_contents: bool = True, search_docs_tags: bool = True, threshold: float = THRESHOLD, max_file_size: int | None = None, max_matches: int = 50,
    skip_hidden_folders: bool = True, skip_noise_folders: bool = True, skip_noise_files: bool = True, match_skipped_names: bool = False, include_archives: bool = False, include_subdirectories: bool = True,
    skipped_files: list[SkippedFile] | None = None, ocr: bool | None = None, transcribe: bool | None = None, semantic_image: bool | None = None,
    semantic_image_threshold: float = PREVIEW_THRESHOLD, transcribe_threshold: float = TRANSCRIPT_THRESHOLD, limit: int | None = None,
    on_progress: Callable[[int, int], None] | None = None, on_activity: Callable[[ActivityUpdate | None], None] | None = None, on_result: Callable[[FileSearchResult], None] | None = None,
    max_line_matches: int | None = None, max_workers: int | None = None, cancel_check: Callable[[], bool] | None = None, allow_process_pool: bool = False,
    ports: Ports | None = None, pictures: Pictures | None = None, spark: SparkSession | None = None,
) -> list[FileSearchResult]:
    """Files that match, best first; of a search that ``cancel_check`` ends, those that it
    had found.  ``on_result`` is told of results while files are searched, and with a limit
    also of such as better ones displace later; ``on_progress`` counts files.
    ``max_workers`` and ``allow_process_pool`` say nothing here: Spark's cores are the
    workers.  Writing and speech need functions for them in ``ports``."""
    if max_line_matches is not None:
        warnings.warn("max_line_matches is now max_matches", DeprecationWarning, stacklevel=2)
        max_matches = max_line_matches
    ports = ports or Ports()
    options = WalkOptions(skip_hidden_folders, skip_noise_folders, skip_noise_files, match_skipped_names, include_archives, include_subdirectories)
    found: list[FileSearchResult] = []

    def tell(event: session.Event) -> None:
        if isinstance(event, session.Progress) and on_progress:
            on_progress(event.completed, event.total)
        elif isinstance(event, session.Activity) and on_activity:
            on_activity(ActivityUpdate(event.label))
        elif isinstance(event, (session.Result, session.Results)):
            rows = [event.row] if isinstance(event, session.Result) else event.rows
            for result in map(FileSearchResult.of, rows):
                found.append(result)
                if on_result:
                    on_result(result)
        elif isinstance(event, session.Skipped) and skipped_files is not None:
            skipped_files.extend(SkippedFile(*s) for s in event.rows)
        elif isinstance(event, session.Finished) and on_activity:
            on_activity(None)

    run = session.SearchSession(_session(spark), tell, cancel_check)
    run.run(ProgressiveSearch(
        run.spark, path, query, names=search_names, contents=search_contents, docs_tags=search_docs_tags, ocr=bool(ocr), transcribe=bool(transcribe),
        pictures=pictures if semantic_image is None or semantic_image else None, threshold=threshold, picture_threshold=semantic_image_threshold, transcript_threshold=transcribe_threshold,
        limit=limit, max_matches=max_matches, max_file_bytes=max_file_size, options=options, ports=ports,
    ))
    return sorted(found, key=lambda r: (-r.score, r.path))[:limit]
