"""Session helpers: a local session for tests and benches, and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_work: str | None = None
_handed_out: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        # Partitioned writes keep one file open per value (event class, date) and so need not sort wide rows.
        .config("spark.sql.maxConcurrentOutputFileWriters", "100")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local session, where driver and executors are one process.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_work
    if _local_work is None or not os.path.isdir(_local_work):
        _local_work = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, _local_work, ignore_errors=True)
    return _local_work


def new_work_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def release_work(spark: SparkSession) -> None:
    """Remove every work table of this process. Results that read them must be written by then."""
    while _handed_out:
        path = spark._jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: many readers, no recomputation, short lineage."""
    return write_and_read(df, new_work_path(df.sparkSession, label), partition_by)


def write_and_read(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
