"""Instants shown in a wall-clock zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_time(instant: str | Column, tz: str = "America/New_York") -> Column:
    """Wall-clock time of an instant in ``tz``. For showing and grouping by day; never order by it.

    The instant is counted from the epoch in UTC first: a session zone with repeated hours takes no part.
    """
    instant = F.col(instant) if isinstance(instant, str) else instant
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    micros = F.unix_micros(instant.cast("timestamp"))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), epoch + seconds)


def utc_date(instant: str | Column) -> Column:
    """The UTC date of an instant: what stored partitions are named by, whatever the session zone."""
    instant = F.col(instant) if isinstance(instant, str) else instant
    return F.date_from_unix_date(F.floor(F.unix_micros(instant.cast("timestamp")) / F.lit(86_400_000_000)).cast("int"))
