import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from helpers import at, login_xml, rows, statement_xml
from tracewell.functions.times import display_time
from tracewell.model import RAW_EVENT
from tracewell.operators import epochs
from tracewell.operators.events import (
    decode_logins,
    extract_statements,
    flatten_events,
    login_payloads,
    quarantined_logins,
    unreadable_events,
    user_activity,
)
from tracewell.plans.audit import audit_batch, audit_columns
from tracewell.sources.trace import parse_trace_events, read_trace_xml


def flat(spark, *xml, **options):
    raw = spark.createDataFrame([("T_0_1.xml", i, x) for i, x in enumerate(xml)], RAW_EVENT)
    return flatten_events(parse_trace_events(raw), **options)


def test_statement_fields(spark):
    x = statement_xml(12, at(1, 5), 60, "  select 'a' & <b>\n", cpu_time=7, writes=3, duration="n/a", row_count="")
    got = extract_statements(flat(spark, x)).first().asDict()
    assert got["statement"] == "  select 'a' & <b>\n"
    assert (got["event_sequence"], got["session_id"], got["cpu_time"], got["writes"]) == (12, 60, 7, 3)
    assert got["dur_micro_sec"] is None and got["row_count"] is None and got["physical_reads"] is None
    assert got["event_time"] == at(1, 5)
    parity = flat(spark, x, writes_from_cpu_time=True)
    assert extract_statements(parity).first()["writes"] == 7


def test_first_node_wins_and_defaults(spark):
    x = statement_xml(1, at(1), 60, "s", database=None, cpu_time=1).replace(
        "</event>", '<data name="cpu_time"><value>2</value></data></event>'
    )
    got = extract_statements(flat(spark, x)).first()
    assert got["cpu_time"] == 1 and got["database_name"] == "nom de base de données absent"
    assert extract_statements(flat(spark, x, missing_database="?")).first()["database_name"] == "?"


def test_unreadable_xml_is_set_apart(spark):
    f = flat(spark, "<event name='x'", "rubbish", None, statement_xml(1, at(1), 60, "s"))
    assert rows(unreadable_events(f)) == [("T_0_1.xml", 0), ("T_0_1.xml", 1), ("T_0_1.xml", 2)]
    assert extract_statements(f).count() == 1 and decode_logins(f).count() == 0


def test_logins_round_trip_and_quarantine(spark):
    bad = ["zz00", "5B0", "5B", "00D8", "hello".encode("utf-16-le").hex(), "[{}]".encode("utf-16-le").hex(), None,
           '[{"LoginName":"x"}]'.encode("utf-16-le").hex()]
    xml = [login_xml(1, at(1), 61, "josé\U0001f600", "10.0.0.1", "app"), login_xml(2, at(1), 62, "b")]
    xml += [login_xml(10 + i, at(1), 0, "", user_data=b or "") for i, b in enumerate(bad) if b]
    xml.append('<event name="user_event" timestamp="2024-03-01T00:00:00Z"><action name="event_sequence"><value>16</value></action></event>')
    f = flat(spark, *xml)
    assert rows(decode_logins(f), "login_name", "session_id", "client_net_address", "client_app_name", "event_sequence") == sorted(
        [("josé\U0001f600", 61, "10.0.0.1", "app", 1), ("b", 62, None, None, 2)], key=repr
    )
    reasons = {r["event_sequence"]: r["reason"] for r in quarantined_logins(f).collect()}
    assert reasons == {
        10: "not UTF-16LE hex",
        11: "not UTF-16LE hex",
        12: "not UTF-16LE hex",
        13: "not UTF-16LE hex",
        14: "not a JSON login",
        15: "not a JSON login",
        16: "no payload",
        17: "login or session missing",
    }


def test_payloads_take_the_program_of_the_session(spark):
    logins = spark.createDataFrame(
        [(60, "l", dt.datetime(2024, 1, 1), None), (61, "m", dt.datetime(2024, 1, 1), "h")],
        "session_id int, login_name string, login_time timestamp_ntz, client_net_address string",
    )
    sessions = spark.createDataFrame([(60, "prog")], "session_id int, program_name string")
    coded = login_payloads(logins, sessions).select(F.lit("login").alias("event_class"), "user_data")
    got = rows(decode_logins(coded), "login_name", "session_id", "client_net_address", "client_app_name")
    assert got == sorted([("l", 60, None, "prog"), ("m", 61, "h", None)], key=repr)


def test_user_activity(spark):
    df = spark.createDataFrame([(50, False), (51, False), (52, True)], "session_id int, is_system boolean")
    assert rows(user_activity(df, is_system="is_system")) == [(51, False)]


def test_epochs(spark):
    events = [
        ("T_0_01", 5, at(1, 1)),  # before any restart
        ("T_0_02", 1, at(1, 2)),
        ("T_0_02", 2, at(1, 3)),
        ("T_0_03", 3, at(1, 4)),
        ("T_0_04", 9, at(1, 4)),  # whole file belongs to the restart it holds
        ("T_0_04", 1, at(1, 5)),
        ("T_0_05", 2, at(1, 6)),
    ]
    df = spark.createDataFrame(events, "file_name string, event_sequence long, event_time timestamp")
    got = epochs.assign_epoch(df, initial=at(1, 0))
    expected = {"T_0_01": at(1, 0), "T_0_02": at(1, 2), "T_0_03": at(1, 2), "T_0_04": at(1, 5), "T_0_05": at(1, 5)}
    assert {(r.file_name, r.epoch) for r in got.collect()} == set(expected.items())
    assert got.count() == len(events)
    assert rows(epochs.rank_epochs(got)) == [(at(1, 0), 3), (at(1, 2), 2), (at(1, 5), 1)]


def test_display_time_over_dst(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-11-03 05:30:00Z', timestamp'2024-11-03 06:30:00Z')) t")
    shown = [r[0] for r in df.select(display_time("t")).collect()]
    assert shown == [dt.datetime(2024, 11, 3, 1, 30)] * 2


def test_batch_and_xml_folder(spark, tmp_path):
    xml = [
        login_xml(1, at(1, 1), 60, "ann", "10.0.0.1", "app"),
        statement_xml(2, at(1, 2), 60, "select 1", cpu_time=4),
        statement_xml(2, at(1, 2), 60, "select 1", cpu_time=4),  # the same event twice
        statement_xml(3, at(1, 3), 61, "select 2"),
        "broken",
    ]
    raw = spark.createDataFrame([("T_0_1.xml", i, x) for i, x in enumerate(xml)], RAW_EVENT)
    batch = audit_batch(raw)
    got = rows(audit_columns(batch.audit), "statement", "client_net_address", "client_app_name", "source", "epoch")
    assert got == [
        ("select 1", "10.0.0.1", "app", "asof", at(1, 1)),
        ("select 2", "session is gone", "Client program disconnected", "none", at(1, 1)),
    ]
    assert os.path.isdir(batch.events_path)
    assert batch.logins.count() == 1 and batch.quarantine.count() == 0 and batch.unreadable.count() == 1

    batch.release()
    assert not os.path.exists(batch.events_path)

    (tmp_path / "T_0_1.xml").write_text("<events>\n" + "\n".join(xml[:4]) + "\n</events>")
    folder = flatten_events(read_trace_xml(spark, str(tmp_path)))
    assert rows(folder, "file_name", "event_name", "event_sequence", "statement") == rows(
        flatten_events(parse_trace_events(raw.where("file_offset < 4"))),
        "file_name", "event_name", "event_sequence", "statement",
    )
