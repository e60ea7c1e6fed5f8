"""Bring tables of the earlier, French-named versions to the current columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.model import CHECKPOINT, CONNECTIONS, DEFAULT_EPOCH, FULL_AUDIT, PROCESS_LOG

# Old table names and their successors.
TABLES = {
    "EvenementsTraitesSuivi": "checkpoint",
    "ExtEvProcessedChkPoint": "checkpoint",
    "HistoriqueConnexions": "connections_history",
    "ConnectionsHistory": "connections_history",
    "AuditComplet": "full_audit",
    "FullAudit": "full_audit",
    "LogTraitementAudit": "process_log",
    "ProcessAuditLog": "process_log",
}

# Old column names and their successors.
COLUMNS = {
    "DateSuivi": "chk_point_time",
    "ChkPointTime": "chk_point_time",
    "last_Offset_done": "last_offset_done",
    "ExtEvSessCreateTime": "epoch",
    "ExtendedSessionCreateTime": "epoch",
    "FirstEventTimeOfSession": "epoch",
    "LoginName": "login_name",
    "LoginTime": "login_time",
    "Session_id": "session_id",
    "Client_net_address": "client_net_address",
    "DurMicroSec": "dur_micro_sec",
    "MsgDate": "msg_date",
    "Msg": "msg",
}

_SCHEMAS = {
    "checkpoint": CHECKPOINT,
    "connections_history": CONNECTIONS,
    "full_audit": FULL_AUDIT,
    "process_log": PROCESS_LOG,
}


def migrate_legacy(df: DataFrame, table: str) -> DataFrame:
    """Rename, drop what is obsolete and add what is missing: one projection, no shuffle.

    A missing epoch becomes 2000-01-01 where the table needs one, other missing columns NULL.
    """
    table = TABLES.get(table, table)
    old = {c.lower(): c for c in COLUMNS}
    df = df.withColumnsRenamed({c: COLUMNS[old[c.lower()]] for c in df.columns if c.lower() in old})
    present = {c.lower(): c for c in df.columns}
    out = []
    for field in _SCHEMAS[table]:
        if field.name in present:
            value = F.col(present[field.name]).cast(field.dataType)
        elif field.name == "epoch" and table != "full_audit":
            value = F.lit(DEFAULT_EPOCH).cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def migrate_legacy_audit(df: DataFrame) -> DataFrame:
    return migrate_legacy(df, "full_audit")
