"""Progress of continuous queries and batch stages as plain events."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Progress:
    stage: str
    current: int
    total: int | None
    message: str


class ProgressListener(StreamingQueryListener):
    """Calls back after every batch with the rows done so far; register it with spark.streams.addListener."""

    def __init__(self, tell: Callable[[Progress], None]):
        self.tell = tell
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.tell(Progress("started", 0, None, event.name or str(event.id)))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.tell(Progress("batch", self.rows[str(p.id)], None, p.name or str(p.id)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(Progress("failed" if event.exception else "finished", self.rows.get(str(event.id), 0), None, event.exception or ""))


@contextmanager
def stage(name: str, number: int, total: int, tell: Callable[[Progress], None]):
    """Tells before and after a batch stage."""
    tell(Progress(name, number - 1, total, "started"))
    yield
    tell(Progress(name, number, total, "finished"))


class _Names(AccumulatorParam):
    def zero(self, value: list) -> list:
        return []

    def addInPlace(self, value1: list, value2: list) -> list:
        value1.extend(value2)
        return value1


@contextmanager
def watched(rows: DataFrame, name: str, total: int, tell: Callable[[Progress], None], stage: str = "analyzing", every: float = 0.2) -> Iterator[DataFrame]:
    """Gives the rows unchanged; while an action runs on them, tells one event per row with the running count.

    name: a column that tells rows apart.  Tasks report the names they passed on when they end, in an
    accumulator that the driver looks at; a name that a retried task reports again is told once.
    """
    passed, seen, done = rows.sparkSession.sparkContext.accumulator([], _Names()), set(), threading.Event()
    place = rows.columns.index(name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            passed.add([str(x) for x in batch.column(place).to_pylist()])

    def look() -> None:
        at = 0
        while True:
            last = done.wait(every)
            names = passed.value
            for photo in names[at:]:
                if photo not in seen:
                    seen.add(photo)
                    tell(Progress(stage, len(seen), total, f"{photo} ({len(seen)}/{total})"))
            at = len(names)
            if last:
                return

    watcher = threading.Thread(target=look, daemon=True)
    watcher.start()
    try:
        yield rows.mapInArrow(count, rows.schema)
    finally:
        done.set()
        watcher.join()
