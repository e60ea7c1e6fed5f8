"""A bitmap of fixed size that says which ids may be in a set.

It lets a pass over wide rows settle most of them in place, so that only rows that may have a partner are shuffled. A
wrong "may be" costs a shuffled row, never a result. The size does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def bit_of(*cols: str | Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits)).cast("int")


def bitmap(df: DataFrame, *cols: str, bits: int = BITS) -> bytes:
    """One bit for each hash of ``cols``: at most ``bits / 64`` rows of a number each come to the driver."""
    return bitmap_of_bits(df.select(bit_of(*cols, bits=bits).alias("bit")), bits)


def bitmap_of_bits(df: DataFrame, bits: int = BITS) -> bytes:
    """The same from a column ``bit`` of bit numbers."""
    words = df.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("mask")
    )
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.tobytes()


def may_contain(map_bytes: bytes, positions: np.ndarray) -> np.ndarray:
    words = np.frombuffer(map_bytes, np.int64)
    return (words[positions >> 6] >> (positions & 63) & 1).astype(bool)


def rows_in(map_bytes: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the rows whose ``bit`` is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_contain(map_bytes, batch.column("bit").to_numpy())))

    return run
