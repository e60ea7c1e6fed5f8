"""Load monitoring: hot-CPU statement ranking, counter differences, offset checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.gates import all_match, keep_if


def cpu_is_hot(samples: DataFrame, threshold: int = 75, last: int = 4) -> DataFrame:
    """One boolean: were all of the last samples above the threshold? Open when there are none."""
    recent = samples.orderBy(F.desc("record_id")).limit(last)
    return all_match(recent, F.col("sql_cpu_utilization") > threshold)


def statement_text(text: str, start: str, end: str):
    """The statement inside its batch; offsets count bytes of UTF-16 from 0, end -1 means to the end."""
    begin = F.floor(F.col(start) / 2).cast("int")
    size = F.when(F.col(end) == -1, F.length(text)).otherwise(F.floor(F.col(end) / 2).cast("int")) - begin
    return F.substring(F.col(text), begin + 1, size)


def top_statements(stats: DataFrame, top: int = 25, tie: Sequence[str] = ()) -> DataFrame:
    """The costliest statements by total CPU, with integer average cost per execution."""
    average = F.when(F.col("execution_count") != 0, F.expr("total_worker_time div execution_count"))
    return (
        stats.withColumn("avg_cpu_time", average).orderBy(F.desc("total_worker_time"), *tie).limit(top)
    )


def top_statements_when_hot(
    samples: DataFrame,
    stats: DataFrame,
    threshold: int = 75,
    last: int = 4,
    top: int = 25,
    tie: Sequence[str] = (),
) -> DataFrame:
    return top_statements(keep_if(stats, cpu_is_hot(samples, threshold, last)), top, tie)


def snapshot_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Growth of each counter between two snapshots, for keys present in both."""
    keys = list(keys)
    then = before.select(*keys, *[F.col(c).alias(f"__{c}") for c in counters])
    return after.join(then, keys).select(
        *keys, *[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_in_interval") for c in counters]
    )


def offset_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("file_name", "file_offset").agg(F.count(F.lit(1)).alias("n"))


def offset_profile(events: DataFrame) -> DataFrame:
    """Per file the last offset but one and the last, each with its number of events."""
    latest = Window.partitionBy("file_name").orderBy(F.desc("file_offset"))
    ends = offset_counts(events).withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= 2)

    def at(rank: int, c: str):
        return F.max(F.when(F.col("rn") == rank, F.col(c)))

    return (
        ends.groupBy("file_name")
        .agg(
            at(2, "file_offset").alias("file_offset"),
            at(2, "n").alias("n"),
            at(1, "file_offset").alias("last_offset"),
            at(1, "n").alias("last_count"),
        )
        .where(F.col("file_offset").isNotNull())
    )


def offset_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Offsets already read whose number of events changed on a second reading. Should be none."""
    again = offset_counts(after).withColumnRenamed("n", "n_after")
    return (
        offset_counts(before)
        .join(again, ["file_name", "file_offset"], "left")
        .withColumn("n_after", F.coalesce("n_after", F.lit(0).cast("long")))
        .where(F.col("n_after") != F.col("n"))
    )
