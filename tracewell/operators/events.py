"""Flat trace events, split into logins and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.fields import action_value, data_value
from tracewell.functions.text import text_to_utf16_hex, utf16_hex_to_text
from tracewell.model import LOGIN_EVENT, LOGIN_PAYLOAD, METRICS, MIN_USER_SESSION, NO_DATABASE

LOGIN, STATEMENT, UNREADABLE = "login", "statement", "unreadable"

STATEMENT_COLUMNS = ["server_principal_name", "session_id", "database_name", "statement", *METRICS]


def event_class(name: str = "event_name"):
    return (
        F.when(F.col(name).isNull(), UNREADABLE).when(F.col(name) == LOGIN_EVENT, LOGIN).otherwise(STATEMENT)
    )


def user_activity(df: DataFrame, session: str = "session_id", is_system: str | None = None) -> DataFrame:
    """Drop server sessions: user sessions are numbered above 50."""
    df = df.where(F.col(session) > MIN_USER_SESSION)
    return df.where(~F.col(is_system)) if is_system else df


def flatten_events(
    parsed: DataFrame, missing_database: str = NO_DATABASE, writes_from_cpu_time: bool = False
) -> DataFrame:
    """Replace the nodes of an event by typed columns and its class.

    A node that is missing or not a number gives NULL. Flat columns are what later readers prune: the summary
    of an as-of join, for one, reads three of them and never the statement text.
    """

    def number(name: str):
        return data_value(name).try_cast("long")

    kept = [c for c in parsed.columns if c != "event"]
    is_statement = event_class() == STATEMENT
    return parsed.select(
        *kept,
        event_class().alias("event_class"),
        action_value("server_principal_name").alias("server_principal_name"),
        action_value("session_id").try_cast("int").alias("session_id"),
        F.when(is_statement, F.coalesce(action_value("database_name"), F.lit(missing_database))).alias("database_name"),
        data_value("statement").alias("statement"),
        number("duration").alias("dur_micro_sec"),
        number("cpu_time").alias("cpu_time"),
        number("logical_reads").alias("logical_reads"),
        number("cpu_time" if writes_from_cpu_time else "writes").alias("writes"),
        number("row_count").alias("row_count"),
        number("physical_reads").alias("physical_reads"),
        data_value("user_data").alias("user_data"),
    )


def extract_statements(flat: DataFrame) -> DataFrame:
    """Statement events with their audit columns."""
    dropped = ("event_class", "event_name", "user_data")
    return flat.where(F.col("event_class") == STATEMENT).select(*[c for c in flat.columns if c not in dropped])


def unreadable_events(flat: DataFrame) -> DataFrame:
    """Events whose XML could not be read."""
    return flat.where(F.col("event_class") == UNREADABLE).select("file_name", "file_offset")


def _decoded(flat: DataFrame) -> DataFrame:
    """Logins with one row per payload element; an unreadable payload keeps its row, with NULLs."""
    dropped = {"event_class", "event_name", "user_data", *STATEMENT_COLUMNS}
    kept = [c for c in flat.columns if c not in dropped]
    return (
        flat.where(F.col("event_class") == LOGIN)
        .select(*kept, "user_data", utf16_hex_to_text("user_data").alias("payload"))
        .withColumn("items", F.from_json("payload", LOGIN_PAYLOAD))
        .withColumn("item", F.explode_outer("items"))
        .select(
            *kept,
            "user_data",
            "payload",
            F.col("item.LoginName").alias("login_name"),
            F.col("item.spid").try_cast("int").alias("session_id"),
            F.col("item.LoginTime").try_cast("timestamp_ntz").alias("login_time"),
            F.col("item.client_net_address").alias("client_net_address"),
            F.col("item.client_app_name").alias("client_app_name"),
        )
    )


def _usable():
    return F.col("login_name").isNotNull() & F.col("session_id").isNotNull()


def decode_logins(flat: DataFrame) -> DataFrame:
    """Who logged in, from where and with which program: hex, then UTF-16LE text, then a JSON array."""
    return _decoded(flat).where(_usable()).drop("user_data", "payload").distinct()


def quarantined_logins(flat: DataFrame) -> DataFrame:
    """Login events that name no login or session, with the step that failed."""
    return _quarantine(_decoded(flat).where(~_usable()).withColumn("reason", _reason()))


def _reason():
    return (
        F.when(F.col("user_data").isNull(), "no payload")
        .when(F.col("payload").isNull(), "not UTF-16LE hex")
        .when(F.coalesce("login_name", F.col("session_id").cast("string")).isNull(), "not a JSON login")
        .otherwise("login or session missing")
    )


def _quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.select("file_name", "event_sequence", "event_time", "user_data", "reason")


def judged_logins(flat: DataFrame) -> DataFrame:
    """All login events decoded, to be written once: those of :func:`decode_logins` without a ``reason``, the others with theirs.

    Payloads stay only where they could not be used.
    """
    reason = F.when(~_usable(), _reason())
    return _decoded(flat).select(
        "*", reason.alias("reason"), F.when(reason.isNotNull(), F.col("user_data")).alias("__payload")
    ).drop("user_data", "payload").withColumnRenamed("__payload", "user_data")


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What :func:`decode_logins` and :func:`quarantined_logins` give, from logins that are decoded already."""
    return judged.where("reason IS NULL").drop("user_data", "reason").distinct(), _quarantine(judged.where("reason IS NOT NULL"))


def login_payloads(logins: DataFrame, sessions: DataFrame, out: str = "user_data") -> DataFrame:
    """The inverse of :func:`decode_logins`: add the payload, with the program name of the live session."""
    programs = sessions.groupBy("session_id").agg(F.max("program_name").alias("program_name"))
    item = F.struct(
        F.col("login_name").alias("LoginName"),
        F.col("login_time").cast("string").alias("LoginTime"),
        F.col("session_id").alias("spid"),
        F.col("client_net_address"),
        F.col("program_name").alias("client_app_name"),
    )
    return (
        logins.join(programs, "session_id", "left")
        .withColumn(out, text_to_utf16_hex(F.to_json(F.array(item))))
        .drop("program_name")
    )
