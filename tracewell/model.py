"""Schemas and settings shared by the whole package."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import types as T

# One row per trace event, as exported by the capture side.
RAW_EVENT = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("file_offset", T.LongType()),
        T.StructField("event_data", T.StringType()),
    ]
)

_NODE = T.ArrayType(
    T.StructType(
        [
            T.StructField("_name", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )
)

# <event name= timestamp= [offset=]><data name=><value/></data>*<action name=><value/></action>*</event>
EVENT_XML = T.StructType(
    [
        T.StructField("_name", T.StringType()),
        T.StructField("_timestamp", T.StringType()),
        T.StructField("_offset", T.LongType()),
        T.StructField("data", _NODE),
        T.StructField("action", _NODE),
    ]
)

LOGIN_PAYLOAD = T.ArrayType(
    T.StructType(
        [
            T.StructField("LoginName", T.StringType()),
            T.StructField("LoginTime", T.StringType()),
            T.StructField("spid", T.StringType()),
            T.StructField("client_net_address", T.StringType()),
            T.StructField("client_app_name", T.StringType()),
        ]
    )
)

CONNECTIONS = T.StructType(
    [
        T.StructField("login_name", T.StringType()),
        T.StructField("session_id", T.IntegerType()),
        T.StructField("login_time", T.TimestampNTZType()),
        T.StructField("client_net_address", T.StringType()),
        T.StructField("client_app_name", T.StringType()),
        T.StructField("epoch", T.TimestampType()),
        T.StructField("event_sequence", T.LongType()),
    ]
)

METRICS = ["dur_micro_sec", "cpu_time", "logical_reads", "writes", "row_count", "physical_reads"]

FULL_AUDIT = T.StructType(
    [
        T.StructField("server_principal_name", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("client_net_address", T.StringType()),
        T.StructField("session_id", T.IntegerType()),
        T.StructField("client_app_name", T.StringType()),
        T.StructField("database_name", T.StringType()),
        T.StructField("statement", T.StringType()),
        T.StructField("epoch", T.TimestampType()),
        T.StructField("event_sequence", T.LongType()),
        *[T.StructField(m, T.LongType()) for m in METRICS],
    ]
)

CHECKPOINT = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("last_offset_done", T.LongType()),
        T.StructField("chk_point_time", T.TimestampType()),
        T.StructField("epoch", T.TimestampType()),
    ]
)

PROCESS_LOG = T.StructType(
    [
        T.StructField("msg_date", T.TimestampType()),
        T.StructField("msg", T.StringType()),
    ]
)

LIVE_SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.IntegerType()),
        T.StructField("program_name", T.StringType()),
        T.StructField("client_net_address", T.StringType()),
    ]
)

# Event names, texts and limits that results must carry unchanged.
LOGIN_EVENT = "user_event"
STATEMENT_EVENTS = ["rpc_completed", "sql_statement_completed"]
LIVE_PREFIX = "(Cur)-> "
NO_PROGRAM = "Client program disconnected"
NO_ADDRESS = "session is gone"
NO_DATABASE = "nom de base de données absent"
LOST_FILE_PREFIX = "Lost audit file: "
MIN_USER_SESSION = 50
RETENTION_DAYS = 45
# A stream slows down after batches of fewer statements, and is silent after so long without an event.
QUIET_ROWS, QUIET_SECONDS, SILENT_SECONDS = 100, 15, 15 * 60
DEFAULT_EPOCH = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)


@dataclass(frozen=True)
class AuditConfig:
    """Options of an audit run; the defaults give the documented behaviour."""

    retention_days: int = RETENTION_DAYS
    missing_database: str = NO_DATABASE
    writes_from_cpu_time: bool = False
    keep_open_sessions: bool = False
    keep_raw: bool = False
    bucket_rows: int = 1_000_000
    initial_epoch: dt.datetime = DEFAULT_EPOCH
