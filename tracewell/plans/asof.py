"""Backward as-of join and previous-value lookup that do not put a whole key into one task.

Both work on rows cut into *buckets*: a bucket is a range of the order key, so that rows of one key
are spread over many tasks however hot the key is. Inside a bucket a window finds the answer; what the
earlier buckets contribute is computed from one summary row per (key, bucket) and joined back on the
columns the rows are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_ROWS = 1_000_000
LOOSE_BUCKETS = 1024

_KIND, _CARRY, _TAG, _BUCKET = "__kind", "__carried", "__tag", "__bucket"
# Order of rows with equal keys: what is stored already, then left rows, then the right ones a strict join must not see.
_STORED, _LEFT, _RIGHT = 0, 1, 2


def sequence_bucket(seq: str | Column, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> Column:
    """Start of the range a sequence lies in. Sequences are unique in an epoch, so a range holds few rows."""
    seq = (F.col(seq) if isinstance(seq, str) else seq).cast("long")
    return seq - F.pmod(seq, F.lit(bucket_rows).cast("long"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    payload: str,
    strict: bool = True,
    per_key: DataFrame | None = None,
    drop_repeats: bool = False,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Attach to each left row the ``payload`` struct of the last right row before it (or at it, if not ``strict``).

    ``bucket`` columns are non-decreasing in the full order ``(bucket, order)``. ``per_key`` is an optional
    frame with one row per ``by`` key; its other columns are attached as well. It is joined to the summary
    and not to the left rows, which are therefore shuffled once. Keys with a NULL never match.
    ``drop_repeats`` keeps one of several left rows with the same full order key (strict joins only); they are
    neighbours in the window already. With ``stored``, the keys of rows written earlier, left rows among those
    are dropped too: an anti join that costs only the shuffle of the stored keys.
    """
    by, bucket, order = list(by), list(bucket), list(order)
    if not by:
        raise ValueError("an as-of join without a key would order all cells in one task: see step_lookup")
    cell = [*by, *bucket]
    right = right.select(*cell, *[o for o in order if o not in cell], payload).dropna(subset=[*cell, *order])

    both = left.withColumn(_KIND, F.lit(_LEFT)).unionByName(
        right.withColumn(_KIND, F.lit(_RIGHT)), allowMissingColumns=True
    )
    if stored is not None:
        keys = stored.select(*cell, *[o for o in order if o not in cell])
        both = both.unionByName(keys.withColumn(_KIND, F.lit(_STORED)), allowMissingColumns=True)
    tie = F.col(_KIND).asc() if strict else F.col(_KIND).desc()
    ordered = Window.partitionBy(*cell).orderBy(*order, tie, F.col(payload))
    last_before = F.last(payload, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    if drop_repeats or stored is not None:
        same = [F.col(o) == F.lag(o).over(ordered) for o in order] + [F.col(b).isNotNull() for b in bucket]
        repeat = F.coalesce(reduce(Column.__and__, same), F.lit(False))
        found = both.withColumns({payload: last_before, _TAG: repeat}).where((F.col(_KIND) == _LEFT) & ~F.col(_TAG))
    else:
        found = both.withColumn(payload, last_before).where(F.col(_KIND) == _LEFT)
    found = found.drop(_KIND, _TAG)

    # One row per (key, bucket): what the buckets before it end with.
    ends = right.groupBy(*cell).agg(F.max(F.struct(*[F.col(o) for o in order], F.col(payload))).alias(_CARRY))
    cells = left.select(*cell).distinct()
    before = (
        Window.partitionBy(*by).orderBy(*bucket, _TAG).rowsBetween(Window.unboundedPreceding, -1)
    )
    summary = (
        cells.withColumn(_TAG, F.lit(0))
        .unionByName(
            ends.select(*cell, F.lit(1).alias(_TAG), F.col(_CARRY)[payload].alias(_CARRY)), allowMissingColumns=True
        )
        .withColumn(_CARRY, F.last(_CARRY, ignorenulls=True).over(before))
        .where(F.col(_TAG) == 0)
        .drop(_TAG)
    )
    if per_key is not None:
        summary = summary.join(per_key, by, "left")
    joined = found.join(summary, cell, "left")
    extra = [c for c in per_key.columns if c not in by] if per_key is not None else []
    return joined.select(
        *[F.col(c) for c in left.columns], F.coalesce(payload, _CARRY).alias(payload), *extra
    )


def asof_attribute(
    left: DataFrame,
    right: DataFrame,
    by: str,
    epoch: str,
    seq: str,
    payload: str,
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
    strict: bool = True,
    per_key: DataFrame | None = None,
    drop_repeats: bool = False,
    stored: DataFrame | None = None,
) -> DataFrame:
    """As-of join on ``by`` under the lexicographic order ``(epoch, seq)``.

    Rows without a sequence match nothing. They are dealt over many buckets below all sequences, so that they are no
    hot cell however many there are (their times and numbers say which); what ``per_key`` knows of them is attached all the same.
    """
    cut = sequence_bucket(seq, bucket_rows)
    narrow = [c for c, kind in left.dtypes if kind in ("bigint", "int", "timestamp", "timestamp_ntz", "double")]
    loose = -1 - F.pmod(F.xxhash64(by, epoch, *narrow), F.lit(LOOSE_BUCKETS))
    out = asof_join(
        left.withColumn(_BUCKET, F.coalesce(cut, loose)),
        right.withColumn(_BUCKET, cut),
        by=[by],
        bucket=[epoch, _BUCKET],
        order=[seq],
        payload=payload,
        strict=strict,
        per_key=per_key,
        drop_repeats=drop_repeats,
        stored=None if stored is None else stored.withColumn(_BUCKET, cut),
    )
    return out.withColumn(payload, F.when(F.col(seq).isNotNull(), F.col(payload))).drop(_BUCKET)


def previous_value(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str,
    default: int = 0,
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
) -> DataFrame:
    """``lag(value, 1, default)`` per ``by`` ordered by the integer ``value`` itself.

    Rows should be distinct on (by, value): then a bucket holds at most ``bucket_rows`` rows of a key.
    """
    by = list(by)
    cell = [*by, _BUCKET]
    cut = df.withColumn(_BUCKET, sequence_bucket(value, bucket_rows))
    local = F.lag(value).over(Window.partitionBy(*cell).orderBy(value))
    ends = cut.groupBy(*cell).agg(F.max(value).alias(_CARRY))
    ends = ends.withColumn(_CARRY, F.lag(_CARRY).over(Window.partitionBy(*by).orderBy(_BUCKET)))
    joined = cut.withColumn(out, local).join(ends, cell, "left")
    return joined.select(
        *df.columns, F.coalesce(F.col(out), F.col(_CARRY), F.lit(default).cast("long")).alias(out)
    )
