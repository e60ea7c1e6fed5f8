"""Epochs: which run of the trace an event belongs to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.model import DEFAULT_EPOCH
from tracewell.plans.steps import step_lookup


def trace_starts(events: DataFrame) -> DataFrame:
    """Files in which the sequence starts again at 1, with the time of that event: one row per restart."""
    return (
        events.where(F.col("event_sequence") == 1)
        .groupBy("file_name")
        .agg(F.min("event_time").alias("epoch"))
        .where(F.col("epoch").isNotNull())
    )


def assign_epoch(
    events: DataFrame,
    starts: DataFrame | None = None,
    initial: dt.datetime = DEFAULT_EPOCH,
) -> DataFrame:
    """Add ``epoch``. A file without a restart continues the epoch of the file before it, by name.

    Files before the first restart seen belong to the ``initial`` epoch, which is never NULL: logins and statements of
    a trace that was exported from the middle of a run still meet.
    """
    if starts is None:
        starts = trace_starts(events)
    return step_lookup(events, "file_name", starts, "file_name", "epoch", out="epoch", default=initial)


def rank_epochs(df: DataFrame, epoch: str = "epoch", out: str = "session_history_rank") -> DataFrame:
    """Distinct epochs, newest first, with their dense rank."""
    return df.select(epoch).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(F.desc(epoch))).cast("long"))
