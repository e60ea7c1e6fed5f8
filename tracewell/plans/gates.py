"""Let a whole frame through, or nothing, depending on one condition computed from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_match(df: DataFrame, condition: Column) -> DataFrame:
    """One row, one boolean: does every row match? No rows at all counts as a match."""
    return df.agg((F.count(F.lit(1)) == F.count(F.when(condition, 1))).alias("open"))


def keep_if(df: DataFrame, gate: DataFrame) -> DataFrame:
    """``df`` when the single value of ``gate`` is true, else no rows. A scalar subquery: no join."""
    return df.where(F.coalesce(gate.scalar(), F.lit(False)))
