"""The whole batch: raw trace events in, attributed statements out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.times import utc_date
from tracewell.model import FULL_AUDIT, LIVE_SESSIONS, AuditConfig
from tracewell.operators.attribution import attribute_with_fallback
from tracewell.operators.epochs import assign_epoch
from tracewell.operators.events import (
    decode_logins,
    extract_statements,
    flatten_events,
    quarantined_logins,
    unreadable_events,
)
from tracewell.session import new_work_path, write_and_read
from tracewell.sources.tables import remove
from tracewell.sources.trace import parse_trace_events

AUDIT_KEY = ["event_time", "epoch", "event_sequence"]
LOGIN_KEY = ["session_id", "epoch", "event_sequence"]


@dataclass
class AuditBatch:
    audit: DataFrame
    logins: DataFrame
    quarantine: DataFrame
    unreadable: DataFrame
    events_path: str

    def release(self) -> None:
        """Remove the stored events, once everything wanted from this batch is written."""
        remove(self.audit.sparkSession, self.events_path)


def audit_batch(
    raw: DataFrame,
    live_sessions: DataFrame | None = None,
    config: AuditConfig = AuditConfig(),
    events_path: str | None = None,
) -> AuditBatch:
    """Parse, date and split the events, then attribute each statement.

    The events are parsed once, flattened, and written by class: logins and statements are then read from
    folders of their own, and readers that need only the keys read only those columns. The stored events go to
    ``events_path``, or to the shared work folder.
    """
    events_path = events_path or new_work_path(raw.sparkSession, "events")
    if live_sessions is None:
        live_sessions = raw.sparkSession.createDataFrame([], LIVE_SESSIONS)
    flat = flatten_events(parse_trace_events(raw), config.missing_database, config.writes_from_cpu_time)
    flat = write_and_read(flat, events_path, partition_by="event_class")
    dated = assign_epoch(flat, initial=config.initial_epoch)
    logins = decode_logins(dated)
    attributed = attribute_with_fallback(
        extract_statements(dated), logins, live_sessions, config.bucket_rows, drop_repeats=True
    )
    return AuditBatch(
        audit=attributed,
        logins=logins,
        quarantine=quarantined_logins(dated),
        unreadable=unreadable_events(flat),
        events_path=events_path,
    )


def audit_columns(attributed: DataFrame) -> DataFrame:
    return attributed.select(*FULL_AUDIT.names, "source", utc_date("event_time").alias("event_date"))
