"""Step lookup: the value that holds from a start key until the next start key."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import materialise

_VALUE, _KIND, _CELL, _RANGE, _ENDS, _TOP = "__step", "__kind", "__cell", "__range", "__ends", "__top"
#: Characters that tell cells of text keys apart, after what all keys have in common, and ranges of cells likewise.
CELL_LENGTH, RANGE_LENGTH = 6, 3


def _common_length(keys: DataFrame, key: str) -> int:
    """Characters that all keys begin with."""
    first, last = keys.agg(F.min(key), F.max(key)).first()
    return len(os.path.commonprefix([first or "", last or ""]))


def _cut(df: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    """Add the cell of each key and the range of cells it lies in; both are non-decreasing in the key."""
    if isinstance(kind, T.StringType):
        length = _common_length(df, key)
        cell, wide = F.substring(key, 1, length + CELL_LENGTH), F.substring(key, 1, length + RANGE_LENGTH)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        cell, wide = (F.date_trunc(unit, F.col(key)).cast(kind) for unit in ("day", "year"))
    else:
        cell, wide = (F.floor(F.col(key) / F.lit(n)).cast("long") for n in (1_000_000, 1_000_000_000))
    return df.withColumns({_CELL: cell, _RANGE: wide})


def _last_before(ends: Column, field: str, own: Column) -> Column:
    """Value of the last of the sorted ``ends`` whose ``field`` lies before ``own``; NULL without one."""
    return F.try_element_at(F.filter(ends, lambda e: e[field] < own), F.lit(-1))[_VALUE]


def step_lookup(
    df: DataFrame, key: str, steps: DataFrame, start: str, value: str, out: str, default=None
) -> DataFrame:
    """Add ``out``: the ``value`` of the greatest ``start`` at or below ``key``, else ``default``.

    A NULL value of a step does not hide the step before it; of several steps with one start the greatest value holds;
    a NULL start is no step and a NULL key gets the default. The distinct keys (one per file, or per week) and the steps are
    resolved together by a prefix scan of three levels: a window inside each cell of keys; the last steps of the earlier cells of
    a range, as one sorted array a range; the last steps of the earlier ranges, as one array in all. Cells and ranges are the
    characters in which keys begin to differ, days and years, or ranges of numbers, so an array holds about a thousand
    entries and no task orders all keys. The rows are then joined with their keys; whether that is a broadcast is
    Spark's choice by size and changes no value.
    """
    kind = steps.schema[start].dataType
    marks = steps.where(F.col(value).isNotNull() & F.col(start).isNotNull())
    marks = marks.select(F.col(start).alias(key), F.col(value).alias(_VALUE), F.lit(0).alias(_KIND))
    keys = df.select(key).distinct().select(F.col(key).cast(kind).alias(key), F.lit(1).alias(_KIND))
    # A row for each file or week, not for each event: written once, as everything below reads it again.
    both = materialise(marks.unionByName(keys, allowMissingColumns=True).where(F.col(key).isNotNull()), "steps")
    both = _cut(both, key, kind)

    inside = Window.partitionBy(_CELL).orderBy(key, _KIND, _VALUE)
    found = both.withColumn(_VALUE, F.last(_VALUE, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct(key, _VALUE))[_VALUE].alias(_VALUE)
    ends = both.where(F.col(_KIND) == 0).groupBy(_RANGE, _CELL).agg(last)
    entry = F.struct(F.col(_CELL), F.col(_VALUE))
    of_range = ends.groupBy(_RANGE).agg(F.sort_array(F.collect_list(entry)).alias(_ENDS))
    top = F.struct(F.col(_RANGE), F.element_at(_ENDS, -1)[_VALUE].alias(_VALUE))
    of_all = of_range.agg(F.sort_array(F.collect_list(top)).alias(_ENDS)).scalar()

    joined = found.where(F.col(_KIND) == 1).join(of_range, _RANGE, "left").withColumn(_TOP, of_all)
    resolved = joined.select(
        key,
        F.coalesce(
            _VALUE, _last_before(F.col(_ENDS), _CELL, F.col(_CELL)), _last_before(F.col(_TOP), _RANGE, F.col(_RANGE))
        ).alias(out),
    )
    last_resort = F.lit(default).cast(steps.schema[value].dataType)
    return df.join(resolved, key, "left").select(*df.columns, F.coalesce(F.col(out), last_resort).alias(out))
