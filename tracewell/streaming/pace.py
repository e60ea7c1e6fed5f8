"""How a stream that never ends keeps pace with its source: waits after small batches, and a word when nothing comes."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tracewell.model import QUIET_ROWS, QUIET_SECONDS, SILENT_SECONDS


@dataclass(frozen=True)
class Pace:
    """After a batch of fewer than ``quiet_rows`` statements the stream waits, so that small batches do not become many small
    files. Without events for ``silent_seconds`` it says so in the log, once until the next event."""

    quiet_rows: int = QUIET_ROWS
    quiet_seconds: float = QUIET_SECONDS
    silent_seconds: float = SILENT_SECONDS
    wait: Callable[[float], None] = time.sleep

    def after(self, statements: int) -> None:
        if statements < self.quiet_rows:
            self.wait(self.quiet_seconds)


def query_name(path: str) -> str:
    return f"audit {path}"


class SilenceListener(StreamingQueryListener):
    """Tells once when a query of the given name has had no events for a while, and when they come again."""

    def __init__(self, name: str, tell: Callable[[str], None], pace: Pace):
        self.name, self.tell, self.pace = name, tell, pace
        self.run, self.last, self.told = None, time.monotonic(), False

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run, self.last, self.told = event.id, time.monotonic(), False

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and event.progress.numInputRows > 0:
            if self.told:
                self.tell("Events come again")
            self.last, self.told = time.monotonic(), False

    def onQueryIdle(self, event) -> None:
        quiet = time.monotonic() - self.last
        if event.id == self.run and not self.told and quiet >= self.pace.silent_seconds:
            self.told = True
            since = dt.datetime.now(dt.timezone.utc) - dt.timedelta(seconds=quiet)
            self.tell(f"No events since {since:%Y-%m-%d %H:%M:%S} UTC")

    def onQueryTerminated(self, event) -> None:
        if event.id == self.run:
            self.run = None


def watch_silence(spark: SparkSession, name: str, tell: Callable[[str], None], pace: Pace) -> SilenceListener:
    listener = SilenceListener(name, tell, pace)
    spark.streams.addListener(listener)
    return listener
