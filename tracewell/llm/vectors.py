"""Reading vectors from an array column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str, *others: str) -> tuple[DataFrame, int]:
    """vec_id, vec (array of double) and ``others`` of rows that can take part, and the length of their vectors.

    Left out: a null id; a vector that is null, zero, or holds null or non-finite components; vectors of another length than
    most have (the shorter one on a tie).
    """
    vec = F.col(vec_col).cast("array<double>")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), *others)
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
        .where(good & F.exists("vec", lambda x: x != 0))
    )
    lengths = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 0
    return kept.where(F.size("vec") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def dots(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products row by row, in an order of summation that depends on the length alone."""
    return (rows * others).sum(axis=1)
