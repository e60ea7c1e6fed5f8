"""Trace event sources: raw tables or XML folders, file listings, and where to resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.fields import action_value
from tracewell.model import EVENT_XML, RAW_EVENT

TRACE_FILE = r"(^|[/\\])[^/\\]*_[0-9][^/\\]*$"


def _shaped(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(
        *kept,
        F.col("event")["_name"].alias("event_name"),
        action_value("event_sequence").try_cast("long").alias("event_sequence"),
        F.col("event")["_timestamp"].try_cast("timestamp").alias("event_time"),
        "event",
    )


def parse_trace_events(raw: DataFrame, text: str = "event_data") -> DataFrame:
    """One ``from_xml`` per event; name, sequence and time become columns, the nodes stay in ``event``.

    XML that cannot be read gives NULLs in every field.
    """
    kept = [c for c in raw.columns if c != text]
    event = F.from_xml(F.col(text), EVENT_XML, {"ignoreSurroundingSpaces": "false"})
    # As the output of a generator the event is parsed once: filters on its fields are not pushed below it,
    # where they would parse the text a second time.
    return _shaped(raw.select(*kept, F.explode(F.array(event)).alias("event")), *kept)


def read_raw_events(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(RAW_EVENT).load(path)


def read_trace_xml(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Read exported XML trace files; ``event/@offset`` is used when the export carries it."""
    events = (
        spark.read.format("xml")
        .schema(EVENT_XML)
        .option("rowTag", "event")
        .option("ignoreSurroundingSpaces", "false")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return trace_xml_events(events)


def trace_xml_events(events: DataFrame) -> DataFrame:
    """Rows of the XML source (batch or stream) in the shape of :func:`parse_trace_events`."""
    shaped = events.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_offset").alias("file_offset"),
        F.struct(*[F.col(c) for c in EVENT_XML.names]).alias("event"),
    )
    return _shaped(shaped, "file_name", "file_offset")


def list_trace_files(spark: SparkSession, path: str, glob: str = "*", name_pattern: str = TRACE_FILE) -> DataFrame:
    """Files of one folder, subfolders excluded. Only names, sizes and times are read, never contents."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modification_time"))
        .where(F.col("path").rlike(name_pattern))
    )


def latest_trace_file(files: DataFrame, path: str = "path") -> DataFrame:
    return files.agg(F.max(path).alias(path))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The row written last, as one struct column ``cp``; NULL without checkpoints."""
    place = F.struct("file_name", "last_offset_done")
    return checkpoints.agg(F.max_by(place, F.struct("chk_point_time", "file_name", "last_offset_done")).alias("cp"))


def _after(cp: Column) -> Column:
    return (
        cp.isNull()
        | (F.col("file_name") > cp["file_name"])
        | ((F.col("file_name") == cp["file_name"]) & (F.col("file_offset") > cp["last_offset_done"]))
    )


def pending_events(
    events: DataFrame, checkpoints: DataFrame | None = None, start: tuple[str, int] | None = None
) -> DataFrame:
    """Everything after the latest checkpoint, or after an explicit ``(file, offset)`` for inspection."""
    if start is not None:
        cp = F.struct(F.lit(start[0]).alias("file_name"), F.lit(start[1]).alias("last_offset_done"))
        return events.where(_after(cp))
    if checkpoints is None:
        return events
    return events.where(_after(latest_checkpoint(checkpoints).scalar()))


def next_events(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One step: the rest of the checkpointed file, else the next file that holds events, else the first file."""
    pending = pending_events(events, checkpoints)
    target = pending.agg(F.min("file_name").alias("file_name"))
    return pending.where(F.col("file_name") == target.scalar())
