"""Attach to each statement the login that opened its session, and say where the answer comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.model import LIVE_PREFIX, NO_ADDRESS, NO_PROGRAM
from tracewell.plans.asof import DEFAULT_BUCKET_ROWS, asof_attribute

_LOGIN, _LIVE = "__login", "__live"


def login_facts(logins: DataFrame) -> DataFrame:
    """Logins as the right side of the as-of join. The struct keeps a match with a NULL address a match."""
    facts = F.struct("client_net_address", "client_app_name")
    return logins.select("session_id", "epoch", "event_sequence", facts.alias(_LOGIN))


def attribute_asof(statements: DataFrame, logins: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Add address and program of the latest login of the same session strictly before the statement."""
    matched = asof_attribute(
        statements, login_facts(logins), "session_id", "epoch", "event_sequence", _LOGIN, bucket_rows
    )
    return matched.select(
        *statements.columns,
        F.col(_LOGIN)["client_net_address"].alias("client_net_address"),
        F.col(_LOGIN)["client_app_name"].alias("client_app_name"),
    )


def attribute_with_fallback(
    statements: DataFrame,
    logins: DataFrame,
    live_sessions: DataFrame,
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
    drop_repeats: bool = False,
    stored: DataFrame | None = None,
) -> DataFrame:
    """As-of login first; if its address is NULL the live session, marked as such; else a fixed text.

    ``source`` tells which of the three gave the address: asof, live or none. ``drop_repeats`` keeps one of
    several copies of an event, as when a restored file is read along with the original; ``stored`` (session_id,
    epoch, event_sequence) names events audited before, which are left out.
    """
    matched = asof_attribute(
        statements,
        login_facts(logins),
        "session_id",
        "epoch",
        "event_sequence",
        _LOGIN,
        bucket_rows,
        per_key=_live_facts(live_sessions),
        drop_repeats=drop_repeats,
        stored=stored,
    )
    return matched.select(*statements.columns, *_named())


def _live_facts(live_sessions: DataFrame) -> DataFrame:
    known = live_sessions.where(F.col("session_id").isNotNull())
    return known.groupBy("session_id").agg(F.max(F.struct("program_name", "client_net_address")).alias(_LIVE))


def _named() -> list[Column]:
    """client_net_address, client_app_name and source from the login and the live session of a row."""
    address, program = F.col(_LOGIN)["client_net_address"], F.col(_LOGIN)["client_app_name"]
    # The live view is asked only when the login gave no address.
    live_address = F.when(address.isNull(), F.col(_LIVE)["client_net_address"])
    live_program = F.when(address.isNull(), F.col(_LIVE)["program_name"])
    return [
        F.coalesce(address, F.concat(F.lit(LIVE_PREFIX), live_address), F.lit(NO_ADDRESS)).alias("client_net_address"),
        F.coalesce(program, F.concat(F.lit(LIVE_PREFIX), live_program), F.lit(NO_PROGRAM)).alias("client_app_name"),
        F.when(address.isNotNull(), "asof").when(live_address.isNotNull(), "live").otherwise("none").alias("source"),
    ]


def login_intervals(new: DataFrame, logins: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """``new`` logins with ``until``: epoch and sequence of the next one of their session among ``logins``, NULL for the last.

    A login answers for the statements of its session after it and up to the next login, and for no others.
    """
    back = {"__epoch": -F.unix_micros(F.col("epoch").cast("timestamp")), "__seq": -F.col("event_sequence")}
    payload = F.struct("epoch", "event_sequence").alias("until")
    return asof_attribute(
        new.withColumns(back),
        logins.withColumns(back).select("session_id", *back, payload),
        "session_id",
        "__epoch",
        "__seq",
        "until",
        bucket_rows,
    ).drop(*back)


def reattributed(
    statements: DataFrame, intervals: DataFrame, live_sessions: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS
) -> DataFrame:
    """Those of the statements that lie in one of the ``login_intervals``, with what its login and the live view say of them.

    This keeps an as-of join up to date: logins that are found late change the answer inside their intervals only. The
    statements may have any columns beside their key; only those of the sessions concerned take part in the as-of join.
    """
    facts = F.struct("client_net_address", "client_app_name", "until").alias(_LOGIN)
    right = intervals.select("session_id", "epoch", "event_sequence", facts)
    own = statements.join(intervals.select("session_id").distinct(), "session_id", "left_semi").select(statements.columns)
    matched = asof_attribute(
        own, right, "session_id", "epoch", "event_sequence", _LOGIN, bucket_rows, per_key=_live_facts(live_sessions)
    )
    until = F.col(_LOGIN)["until"]
    inside = until.isNull() | (F.struct("epoch", "event_sequence") <= until)
    return matched.where(F.col(_LOGIN).isNotNull() & inside).select(*statements.columns, *_named())
