"""A search as a run of events: what it does, how far it is, its results, its end.

Spark's jobs of one run carry one tag, by which they are counted and cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from .file_search import FileSearch
from .progressive import Part, ProgressiveSearch

# Results told one by one, and the least time between two reports.
RESULT_EVENTS, PACE = 250, 0.05


@dataclass(frozen=True)
class Activity:
    label: str


@dataclass(frozen=True)
class Progress:
    """Of a search in parts: files searched and files in all; of others, tasks."""

    completed: int
    total: int


@dataclass(frozen=True)
class Result:
    row: Row


@dataclass(frozen=True)
class Results:
    """Results behind the first RESULT_EVENTS."""

    rows: list[Row]


@dataclass(frozen=True)
class Skipped:
    """What was not read, RESULT_EVENTS at a time; all of it is told."""

    rows: list[Row]


@dataclass(frozen=True)
class Finished:
    """The end: how many results there are, and how many files were not read."""

    count: int
    cancelled: bool = False
    skipped: int = 0


@dataclass(frozen=True)
class Failed:
    message: str


Event = Activity | Progress | Result | Results | Skipped | Finished | Failed


class SearchSession:
    """One run.  ``cancel`` may be called from any thread; results found until then
    stay.  ``cancel_check`` is asked every PACE seconds, by a thread of its own.  Events
    of progress may come from a second thread, never two at a time."""

    def __init__(self, spark: SparkSession, on_event: Callable[[Event], None], cancel_check: Callable[[], bool] | None = None) -> None:
        self.spark, self._tell, self._lock, self._check = spark, on_event, threading.Lock(), cancel_check
        self.tag, self.cancelled, self._done = f"search-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def tell(self, event: Event) -> None:
        with self._lock:
            self._tell(event)

    def cancel(self) -> None:
        self.cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _ask(self) -> None:
        while not self._done.wait(PACE):
            if self._check():
                self.cancel()
                return

    def _jobs(self) -> list[int]:
        """Ids of the jobs that carry this run's tag."""
        return list(self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self.tag))

    def _watch(self) -> None:
        status, told = self.spark.sparkContext.statusTracker(), None
        while not self._done.wait(PACE):
            jobs = [status.getJobInfo(j) for j in self._jobs()]
            stages = [status.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
            now = (sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s))
            if now != told and now[1] and not self._done.is_set():
                self.tell(Progress(*now))
                told = now

    def _rows(self, found: DataFrame) -> int:
        """Tell results a partition at a time; the driver holds no more than one."""
        count, more = 0, []
        for row in found.toLocalIterator():
            if self.cancelled.is_set():
                break
            count += 1
            self._single += 1
            if self._single <= RESULT_EVENTS:
                self.tell(Result(row))
                continue
            more.append(row)
            if len(more) == RESULT_EVENTS:
                self.tell(Results(more))
                more = []
        if more:
            self.tell(Results(more))
        return count

    def _skips(self, skipped: DataFrame) -> int:
        count, held = 0, []
        for row in skipped.toLocalIterator():
            held.append(row)
            count += 1
            if len(held) == RESULT_EVENTS:
                self.tell(Skipped(held))
                held = []
        if held:
            self.tell(Skipped(held))
        return count

    def _whole(self, search: Callable[[], FileSearch]) -> tuple[int, int]:
        threading.Thread(target=self._watch, daemon=True).start()
        found = search()
        count = self._rows(found.results)
        return count, 0 if self.cancelled.is_set() else self._skips(found.skipped)

    def _in_parts(self, search: ProgressiveSearch) -> tuple[int, int]:
        told = 0

        def tell(part: Part) -> None:
            nonlocal told
            self.tell(Progress(part.completed, part.total))
            told += self._rows(part.results)

        found = search.run(tell, self.cancelled.is_set)
        count = min(search.matches, search.limit) if search.limit else search.matches
        return (told if self.cancelled.is_set() else count), 0 if self.cancelled.is_set() else self._skips(found.skipped)

    def run(self, search: Callable[[], FileSearch] | ProgressiveSearch) -> int:
        """How many results were found.  Up to RESULT_EVENTS are told one by one, the rest
        in lists of so many.  A whole search tells them best first at its end; one in parts
        tells those of each part that are among the best so far, so that one that is
        cancelled has told what it found, and its ``best`` is ranked."""
        context, count, skipped, self._single = self.spark.sparkContext, 0, 0, 0
        context.addJobTag(self.tag)
        if self._check:
            threading.Thread(target=self._ask, daemon=True).start()
        try:
            self.tell(Activity("searching"))
            count, skipped = self._in_parts(search) if isinstance(search, ProgressiveSearch) else self._whole(search)
        except Exception as e:
            if not self.cancelled.is_set():
                self.tell(Failed(str(e)))
                raise
            count = search.matches if isinstance(search, ProgressiveSearch) else 0
        finally:
            self._done.set()
            context.removeJobTag(self.tag)
        self.tell(Finished(count, self.cancelled.is_set(), skipped))
        return count


def paced(tell: Callable[[int, int], None], pace: float = PACE) -> Callable[[int, int], None]:
    """``tell`` at the end, and otherwise at most once in ``pace`` seconds."""
    last = [float("-inf")]

    def report(done: int, total: int) -> None:
        now = time.monotonic()
        if done >= total or now - last[0] >= pace:
            last[0] = now
            tell(done, total)

    return report
