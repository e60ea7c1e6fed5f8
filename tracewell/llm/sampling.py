"""Samples of bounded size, drawn where the rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, total: int, most: int, *keys: str, seed: int = 0) -> DataFrame:
    """About ``most`` of the ``total`` rows, all where there are no more, and never over twice ``most``.

    A row is in by the hash of its ``keys``, so reruns agree and no task sorts or gathers candidates of all others. The
    limit only takes effect where very many rows repeat one key.
    """
    if total <= most:
        return df
    bits = 1 << 53
    drawn = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(bits)) < int(bits * most / total)
    return df.where(drawn).limit(2 * most)
