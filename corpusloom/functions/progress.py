"""Progress of a run: what share is done, how long it will take, and in what words."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# The part of a run that each phase takes, in percent, and the words.
BANDS = {"scan": (0, 3), "extract": (3, 45), "enrich": (45, 80), "dedupe": (80, 83), "organise": (83, 97), "tracker": (97, 99), "done": (99, 100)}
UNKNOWN, SOON = "Estimating time remaining...", "Almost done..."

Listener = Callable[[str, int, int, str], None]


def spell(seconds: float) -> str:
    """Minutes and seconds, minutes only where there are any."""
    whole = max(0, round(seconds))
    return f"{whole // 60}m {whole % 60:02d}s" if whole >= 60 else f"{whole}s"


@dataclass
class Progress:
    """Where a run stands.  ``at`` is told how much of a phase is done and tells the
    listener; an unknown phase moves nothing."""

    listener: Listener | None = None
    clock: Callable[[], float] = time.monotonic
    percent: float = 0.0
    began: float = field(init=False)

    def __post_init__(self) -> None:
        self.began = self.clock()

    def at(self, phase: str, done: int, of: int, note: str = "") -> float:
        low, high = BANDS.get(phase, (self.percent, self.percent))
        part = 1.0 if of <= 0 or phase == "done" else min(max(done / of, 0.0), 1.0)
        self.percent = low + part * (high - low)
        if self.listener:
            self.listener(phase, done, of, note)
        return self.percent

    @property
    def elapsed(self) -> float:
        return self.clock() - self.began

    @property
    def left(self) -> float | None:
        """Seconds at the pace so far; None below two percent, at the end, and before
        any time has gone by, when there is no pace."""
        if self.elapsed > 0 and 2 <= self.percent < 100:
            return self.elapsed / self.percent * (100 - self.percent)
        return None

    def __str__(self) -> str:
        left = self.left
        return UNKNOWN if left is None else SOON if left < 1 else f"About {spell(left)} remaining"

    @contextmanager
    def watching(self, spark: SparkSession, phase: str, every: float = 1.0) -> Iterator[None]:
        """Tell, while the body runs, how many tasks of the active stages are over."""
        stop, status = threading.Event(), spark.sparkContext.statusTracker()

        def look() -> None:
            while not stop.wait(every):
                stages = [s for i in status.getActiveStageIds() if (s := status.getStageInfo(i))]
                if stages:
                    self.at(phase, sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages), "tasks")

        watcher = threading.Thread(target=look, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            stop.set()
            watcher.join()
        self.at(phase, 1, 1)
