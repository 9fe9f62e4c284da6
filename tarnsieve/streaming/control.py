"""Control of long scans: cancellation, progress, background runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The scan was asked to stop."""


def task_count(total: int, cores: int, cap: int = 64, most: int = 16_384) -> int:
    """How many tasks hash `total` files: chunks of at most `cap` files, and at least four tasks a core while there are
    enough files; never more than `most` tasks, whose chunks then grow with the number of files."""
    chunk = max(1, min(cap, total // (cores * 4) or 1))
    return max(1, min(most, -(-total // chunk)))


class Scan:
    """One scan's tag, stop signal and progress callback.

    `stage` runs an action under the tag; meanwhile the driver calls progress(stage, done, known), and a stop interrupts
    the tagged jobs.  With `count` (a function, such as an accumulator's value) these are files, known once `known`
    is given; else tasks, from Spark's status tracker.  A task's files count when it ends; tasks that are run again don't take
    the number beyond what is known.
    """

    def __init__(self, spark: SparkSession, progress: Callable[[str, int, int], None] | None = None, stop: threading.Event | None = None, poll: float = 0.2):
        self.spark, self.poll = spark, poll
        self.progress, self.stop = progress or (lambda *_: None), stop or threading.Event()
        self.tag = f"tarnsieve-{uuid.uuid4().hex}"

    def check(self) -> None:
        if self.stop.is_set():
            raise Cancelled

    def stage(self, name: str, action: Callable, known: int | None = None, count: Callable[[], int] | None = None):
        self.check()
        over = threading.Event()
        watcher = threading.Thread(target=self._watch, args=(name, over, known, count), daemon=True)
        self.spark.addTag(self.tag)
        watcher.start()
        try:
            result = action()
        except Exception:
            self.check()  # an interrupted job fails; say why
            raise
        finally:
            over.set()
            watcher.join()
            self.spark.removeTag(self.tag)
        self.check()
        if known is not None:
            self.progress(name, known, known)
        return result

    def _watch(self, name: str, over: threading.Event, known: int | None, count: Callable[[], int] | None) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        while not over.wait(self.poll):
            if self.stop.is_set():
                self.spark.interruptTag(self.tag)
            if count:
                done = count()
                self.progress(name, done if known is None else min(known, done), done if known is None else known)
                continue
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
            self.progress(name, sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))


def in_background(run: Callable[[], dict], finished: Callable[[dict], None]) -> threading.Thread:
    """Runs a scan in a thread; a failure becomes {"error": text}."""

    def body() -> None:
        try:
            result = run()
        except Exception as error:
            result = {"error": str(error)}
        finished(result)

    thread = threading.Thread(target=body, daemon=True)
    thread.start()
    return thread
