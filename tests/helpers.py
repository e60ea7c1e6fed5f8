"""Small builders shared by the tests."""

from __future__ import annotations

import datetime as dt
import json

UTC = dt.timezone.utc


def at(day: int, hour: int = 0, minute: int = 0, second: int = 0) -> dt.datetime:
    return dt.datetime(2024, 3, day, hour, minute, second)


def node(kind, name, value):
    return f'<{kind} name="{name}"><value>{value}</value></{kind}>' if value is not None else ""


def login_xml(seq, when, session, login, address=None, app=None, user_data=None):
    if user_data is None:
        item = {"LoginName": login, "LoginTime": when.isoformat(), "spid": session}
        if address is not None:
            item["client_net_address"] = address
        if app is not None:
            item["client_app_name"] = app
        user_data = json.dumps([item]).encode("utf-16-le").hex().upper()
    return (
        f'<event name="user_event" package="p" timestamp="{when.isoformat()}.0000000Z">'
        + node("data", "event_id", 82)
        + node("data", "user_data", user_data)
        + node("action", "event_sequence", seq)
        + "</event>"
    )


def statement_xml(seq, when, session, text, user="u", database="db", **counters):
    text = text.replace("&", "&amp;").replace("<", "&lt;")
    return (
        f'<event name="sql_statement_completed" package="p" timestamp="{when.isoformat()}.0000000Z">'
        + "".join(node("data", k, v) for k, v in counters.items())
        + node("data", "statement", text)
        + node("action", "server_principal_name", user)
        + node("action", "session_id", session)
        + node("action", "database_name", database)
        + node("action", "event_sequence", seq)
        + "</event>"
    )


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
