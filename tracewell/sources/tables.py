"""Parquet sinks that can be replayed: append what is new, checkpoints, log, raw capture, purge by partition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import new_work_path, write_and_read

def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def has_data(spark: SparkSession, path: str) -> bool:
    fs, folder = _files(spark, path), _path(spark, path)
    return fs.exists(folder) and any(
        not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(folder)
    )


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies right under ``path``."""
    fs, folder = _files(spark, path), _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there with all its text or not at all."""
    fs, draft = _files(spark, path), _path(spark, f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, _path(spark, path)):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def partition_values(spark: SparkSession, path: str, partition: str) -> list[str]:
    """Values of the partition folders right under ``path``."""
    return [n.split("=", 1)[1] for n in names(spark, path) if n.startswith(f"{partition}=")]


def size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of some files."""
    return sum(_files(spark, p).getFileStatus(_path(spark, p)).getLen() for p in paths)


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if has_data(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def not_stored(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet. A NULL in a key equals nothing, so such rows always count as new."""
    return df.join(stored.select(*keys), keys, "left_anti")


def touching(stored: DataFrame, df: DataFrame, partition: str) -> DataFrame:
    """Stored rows of the partitions that ``df`` touches. Rows without a partition value count as touched by such rows.

    The semi join reaches the scan as a dynamic partition filter; there is no list of literals and so no bound on it.
    """
    touched = df.select(F.col(partition).alias("__touched")).distinct()
    return stored.join(touched, F.col(partition).eqNullSafe(F.col("__touched")), "left_semi")


def append_new(
    df: DataFrame, path: str, keys: list[str], partition_by: str | None = None, rebalance: bool = False
) -> None:
    """Append the rows of ``df`` whose key is not in the table at ``path``.

    With ``partition_by``, equal keys must fall in equal partitions; then only the partitions that ``df``
    touches are read. ``rebalance`` gathers small batches into few files per partition and splits large ones.
    """
    spark = df.sparkSession
    if has_data(spark, path):
        stored = spark.read.schema(df.schema).parquet(path)
        if partition_by:
            stored = touching(stored, df, partition_by)
        df = not_stored(df, stored, keys)
    if rebalance:
        df = df.hint("rebalance", partition_by) if partition_by else df.hint("rebalance")
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def batch_checkpoint(batch: DataFrame, stored: DataFrame | None = None, at: dt.datetime | None = None) -> DataFrame:
    """One row: last file of a batch and last offset in it (with its epoch, if known), unless stored already."""
    epoch = F.col("epoch") if "epoch" in batch.columns else F.lit(None).cast("timestamp")
    place = F.struct("file_name", F.col("file_offset").alias("last_offset_done"), epoch.alias("epoch"))
    last = batch.where(F.col("file_name").isNotNull()).agg(F.max(place).alias("place")).dropna().select("place.*")
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    row = last.select("file_name", "last_offset_done", when.alias("chk_point_time"), "epoch")
    return not_stored(row, stored, ["file_name", "last_offset_done"]) if stored is not None else row


def log_messages(messages: DataFrame, path: str, msg: str = "msg", at: dt.datetime | None = None) -> None:
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    messages.select(when.alias("msg_date"), F.col(msg).alias("msg")).write.mode("append").parquet(path)


def capture_raw(batch: DataFrame, path: str, batch_id: int) -> None:
    """Keep the raw events of a batch under its import number; a replayed batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def purge_before(spark: SparkSession, path: str, cutoff: dt.datetime, time_column: str, partition: str) -> list[str]:
    """Retention on a date-partitioned table: drop whole expired partitions, rewrite the one the cutoff splits.

    Returns the dropped partition values. ``cutoff`` is UTC, like the partition dates.
    """
    if not has_data(spark, path):
        return []
    last_day = cutoff.date().isoformat()
    # The partition of undated rows does not sort below a date and so stays.
    dropped = sorted(v for v in partition_values(spark, path, partition) if v < last_day)
    for value in dropped:
        remove(spark, f"{path}/{partition}={value}")
    split = f"{path}/{partition}={last_day}"
    if _files(spark, split).exists(_path(spark, split)):
        # The kept rows are written out first: a partition cannot be overwritten while it is read.
        instant = F.timestamp_micros(F.lit(int(cutoff.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)))
        work = new_work_path(spark, "retention")
        kept = write_and_read(spark.read.parquet(split).where(F.col(time_column) >= instant), work)
        kept.write.mode("overwrite").parquet(split)
        remove(spark, work)
    return dropped
