"""Join of points with the intervals they lie in, without a nested loop.

Intervals are binned by a range of their own length: level ``l`` has bins of ``width * STEP ** l``, and an interval is filed in the at most
``STEP + 1`` bins it touches on the lowest level where these are enough. A point is filed in its one bin of each level that holds an
interval. So both sides meet by equality on (key, level, bin), and the exact range is checked on what meets. Long and unbounded
intervals cost a few rows like short ones. Bins with very many points are dealt over several shares, to each of which their
intervals are sent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = 8
#: Points of one bin that meet its intervals in one place.
SHARE_POINTS = 100_000
_AT, _LOW, _HIGH, _LEVEL, _BIN, _SHARE, _SHARES = "__at", "__low", "__high", "__level", "__bin", "__share", "__shares"


def _number(column: str, kind: T.DataType) -> Column:
    """A number in the order of the column, the same for points and bounds of one type."""
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        # Not by way of the session's zone, where an hour may stand twice.
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("double") if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else c.cast("long")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    by: Sequence[str] = (),
    closed: str = "right",
    width: float | None = None,
    share_points: int = SHARE_POINTS,
) -> DataFrame:
    """Inner join on ``by`` and on ``start`` < ``at`` <= ``end`` (``closed`` "right"; "left", "both" and "neither" likewise).

    A NULL bound is no bound; a NULL point or key lies in nothing; an interval whose end is not above its start holds what its
    bounds say and mostly nothing. Columns of both sides must differ but for ``by``. ``width`` is the length of the shortest bins; by
    default the median length of the intervals.
    """
    by = list(by)
    if closed not in ("right", "left", "both", "neither"):
        raise ValueError(f"closed is right, left, both or neither, not {closed!r}")
    kind = points.schema[at].dataType
    left = points.dropna(subset=[at, *by]).withColumn(_AT, _number(at, kind))
    right = (intervals.dropna(subset=by) if by else intervals).withColumns(
        {_LOW: _number(start, intervals.schema[start].dataType), _HIGH: _number(end, intervals.schema[end].dataType)}
    )
    # One row: how far points reach, so that an open bound ends with them, and the length most intervals have.
    least, most = left.agg(F.min(_AT), F.max(_AT)).first()
    length = F.col(_HIGH) - F.col(_LOW)
    usual, longest = right.agg(F.percentile_approx(F.when(length > 0, length), 0.5), F.max(length)).first()
    if least is None:
        least = most = 0
    width = width or usual or 1
    if not isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        width = max(1, int(width))
    reach = max(float(most) - float(least), float(longest or 0), 1.0)
    top = max(0, math.ceil(math.log(max(1.0, reach / width / STEP), STEP))) + 1
    widths = [width * STEP**level for level in range(top + 1)]
    right = right.withColumns({_LOW: F.greatest(F.coalesce(_LOW, F.lit(least)), F.lit(least)), _HIGH: F.least(F.coalesce(_HIGH, F.lit(most)), F.lit(most))})
    right = right.where(F.col(_HIGH) >= F.col(_LOW))

    def bin_of(column: str, wide: float) -> Column:
        return F.floor(F.col(column) / F.lit(wide)).cast("long")

    span = F.col(_HIGH) - F.col(_LOW)
    level = F.lit(top)
    for number, wide in reversed(list(enumerate(widths[:-1]))):
        level = F.when(span <= wide * STEP, number).otherwise(level)
    right = right.withColumn(_LEVEL, level.cast("int"))
    low, high = (F.element_at(F.array(*(bin_of(c, w) for w in widths)), F.col(_LEVEL) + 1) for c in (_LOW, _HIGH))
    right = right.withColumn(_BIN, F.explode(F.sequence(low, high)))
    # A row for each level in use.
    levels = sorted(r[0] for r in right.select(_LEVEL).distinct().collect())
    filed = F.array(*(F.struct(F.lit(n).alias(_LEVEL), bin_of(_AT, widths[n]).alias(_BIN)) for n in levels))
    if not levels:
        filed = F.array().cast(f"array<struct<{_LEVEL}: int, {_BIN}: bigint>>")
    left = left.withColumn("__filed", F.explode(filed)).select(*points.columns, _AT, f"__filed.{_LEVEL}", f"__filed.{_BIN}")

    # Bins with more points than a share: their number is bounded by all points over ``share_points``.
    cell = [*by, _LEVEL, _BIN]
    hot = left.groupBy(*cell).agg(F.count("*").alias("__n")).where(F.col("__n") > share_points)
    hot = hot.select(*cell, F.ceil(F.col("__n") / share_points).cast("int").alias(_SHARES))
    left = left.join(hot, cell, "left").withColumn(_SHARE, F.coalesce(F.pmod(F.xxhash64(*points.columns), _SHARES), F.lit(0)).cast("int"))
    right = right.join(hot, cell, "left").withColumn(_SHARE, F.explode(F.sequence(F.lit(0), F.coalesce(_SHARES, F.lit(1)) - 1)))
    right = right.select(*intervals.columns, _LEVEL, _BIN, _SHARE)
    met = left.drop(_SHARES).join(right, [*cell, _SHARE])
    above = F.col(at) >= F.col(start) if closed in ("left", "both") else F.col(at) > F.col(start)
    below = F.col(at) <= F.col(end) if closed in ("right", "both") else F.col(at) < F.col(end)
    inside = met.where((F.col(start).isNull() | above) & (F.col(end).isNull() | below))
    return inside.select(*points.columns, *(c for c in intervals.columns if c not in by))
