"""Arrow batches for whole texts."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS, BYTES = 1000, 4 << 20
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES}


def for_texts(df: DataFrame) -> DataFrame:
    """``df`` itself, after lowering the session's rows and bytes per Arrow batch to ``ROWS`` and ``BYTES`` where they are higher.

    A batch is held by the JVM and by the Python worker at once, several times over. The defaults (10,000 rows, no bound of
    bytes) are meant for numbers. Both settings are read when a result is computed, not when it is defined, so they have to stay
    with the session; a caller that sets lower ones keeps them.
    """
    conf = df.sparkSession.conf
    for key, most in _BOUNDS.items():
        now = int(conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``run``, after whose last batch the worker gives its free memory back to the system.

    Python workers live on for later stages; without this they keep the most they ever held, beside the executor's heap.
    """

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return outer
