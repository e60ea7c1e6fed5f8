import json
import random

import pytest

from helpers import at, login_xml, rows, statement_xml
from tracewell.model import LIVE_SESSIONS, RAW_EVENT, AuditConfig
from tracewell.operators.analytics import find_missing_seq, numbered_statements
from tracewell.operators import events as events_module
from tracewell.plans.audit import audit_batch
from tracewell.sources.trace import parse_trace_events
from tracewell.streaming import audit_stream as stream_module
from tracewell.streaming.audit_stream import AuditStore, audit_stream

COLUMNS = ["event_time", "epoch", "event_sequence", "session_id", "statement", "client_net_address", "client_app_name"]


def load(clients=6, each=40, restarts=(90, 300), per_file=60, seed=5):
    """Clients log in before each numbered statement, in sessions reused by others; the trace restarts at times."""
    rng = random.Random(seed)
    todo = [c for c in range(1, clients + 1) for _ in range(each)]
    rng.shuffle(todo)
    sent = dict.fromkeys(range(1, clients + 1), 0)
    files, events, seq, tick = [], [], 0, 0
    for n, client in enumerate(todo):
        if n in restarts or len(events) >= per_file:
            files.append(events)
            events = []
            seq = 0 if n in restarts else seq
        session, tick = rng.randint(51, 54), tick + 1
        when = at(1 + tick // 60, tick % 60 // 3, tick % 60)
        sent[client] += 1
        seq += 2
        text = f"SELECT Fen={client:03d},Seq={sent[client]:05d},x"
        text = f"/*{client:03d}-{sent[client]:05d}*/{text}" if rng.random() < 0.3 else text
        events.append(login_xml(seq - 1, when, session, f"user{client}", f"10.0.0.{client}", f"app{client}"))
        events.append(statement_xml(seq, when, session, text, user=f"user{client}"))
    files.append(events)
    return {f"T_0_{i:018d}.xml": e for i, e in enumerate(files)}


@pytest.fixture(scope="module")
def files():
    return load()


@pytest.fixture(scope="module")
def batch_rows(spark, files):
    raw = [(name, i, x) for name, events in files.items() for i, x in enumerate(events)]
    random.Random(1).shuffle(raw)
    return rows(audit_batch(spark.createDataFrame(raw, RAW_EVENT)).audit, *COLUMNS)


def deliver(spark, incoming, name, events):
    raw = spark.createDataFrame([(name, i, x) for i, x in enumerate(events)], RAW_EVENT)
    raw.coalesce(1).write.mode("append").parquet(incoming)


def test_load_is_complete_and_attributed(spark, files, batch_rows):
    assert len(batch_rows) == 6 * 40
    audit = spark.createDataFrame(batch_rows, ", ".join(
        ["event_time timestamp", "epoch timestamp", "event_sequence long", "session_id int", "statement string",
         "client_net_address string", "client_app_name string"]))
    numbered = numbered_statements(audit)
    assert numbered.count() == 240 and find_missing_seq(numbered, "f", "s", tie="event_sequence").count() == 0
    assert numbered.where("client_net_address <> concat('10.0.0.', f) or client_app_name <> concat('app', f)").count() == 0
    assert audit.select("epoch").distinct().count() == 2 and 90 in range(240)


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_stream_equals_batch_in_any_order(spark, tmp_path, files, batch_rows, order):
    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    names = list(files)
    if order == "shuffled":
        names = names[2:] + names[:2][::-1]  # the files with the first restarts come last
    groups = [names[:3], names[3:4], names[4:]]
    for group in groups:
        for name in group:
            deliver(spark, incoming, name, files[name])
        audit_stream(spark, incoming, store).awaitTermination()
    assert rows(store.audit(), *COLUMNS) == batch_rows
    # Restored files change nothing, alone or along with others, and cause no repair.
    store._replace_from = lambda *a: pytest.fail("a restored file is no reason to replace anything")
    for name in names[:2]:
        deliver(spark, incoming, name, files[name])
    audit_stream(spark, incoming, store, max_files_per_trigger=1).awaitTermination()
    assert rows(store.audit(), *COLUMNS) == batch_rows
    assert store.logins().count() == 240
    assert store.checkpoints().agg({"file_name": "max"}).first()[0] == max(files)


def test_a_batch_run_twice_changes_nothing(spark, tmp_path, files):
    from tracewell.sources.trace import parse_trace_events

    store = AuditStore(spark, str(tmp_path / "store"))
    names = list(files)
    parts = [
        parse_trace_events(spark.createDataFrame([(n, i, x) for n in g for i, x in enumerate(files[n])], RAW_EVENT))
        for g in (names[:2], names[2:4])
    ]
    store.process(parts[0], 0)
    store.process(parts[1], 1)
    once = rows(store.audit(), *COLUMNS)
    store.process(parts[1], 1)
    assert rows(store.audit(), *COLUMNS) == once


def test_raw_capture_is_a_switch(spark, tmp_path):
    incoming = str(tmp_path / "in")
    deliver(spark, incoming, "T_0_1.xml", [statement_xml(7, at(1, 2), 60, "a"), "broken"])
    for keep in (True, False):
        store = AuditStore(spark, str(tmp_path / f"store{keep}"), AuditConfig(keep_raw=keep))
        audit_stream(spark, incoming, store).awaitTermination()
        assert (tmp_path / f"store{keep}" / "raw").exists() == keep
    assert spark.read.parquet(str(tmp_path / "storeTrue" / "raw")).count() == 2


def test_late_file_keeps_earlier_live_answers(spark, tmp_path):
    incoming = str(tmp_path / "in")
    store = AuditStore(spark, str(tmp_path / "store"), AuditConfig(initial_epoch=at(1)))
    live = [spark.createDataFrame([(60, "p1", "h1"), (61, "p1", "h1")], LIVE_SESSIONS)]
    deliver(spark, incoming, "T_0_2.xml", [statement_xml(7, at(1, 2), 60, "a"), statement_xml(8, at(1, 2), 61, "b")])
    audit_stream(spark, incoming, store, live_sessions=lambda s: live[0]).awaitTermination()
    live[0] = spark.createDataFrame([(61, "p2", "h2")], LIVE_SESSIONS)
    deliver(spark, incoming, "T_0_1.xml", [login_xml(2, at(1, 1), 60, "ann", "10.0.0.1", "app"), statement_xml(3, at(1, 1), 61, "c")])
    audit_stream(spark, incoming, store, live_sessions=lambda s: live[0]).awaitTermination()
    assert rows(store.audit(), "statement", "client_net_address", "source") == [
        ("a", "10.0.0.1", "asof"),  # its login came late
        ("b", "(Cur)-> h1", "live"),  # said while the session was h1's
        ("c", "(Cur)-> h2", "live"),
    ]


def test_xml_files_and_retention(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    xml = [login_xml(1, at(1), 60, "ann", "h", "a"), statement_xml(2, at(1, 1), 60, "old"), statement_xml(3, at(9, 1), 60, "new")]
    (incoming / "T_0_1.xml").write_text("<events>" + "".join(xml) + "</events>")
    store = AuditStore(spark, str(tmp_path / "store"))
    audit_stream(spark, str(incoming), store, format="xml").awaitTermination()
    assert rows(store.audit(), "statement", "client_net_address") == [("new", "h"), ("old", "h")]
    assert store.apply_retention(at(9, 12).replace(month=4, day=20)) == ["2024-03-01"]
    assert rows(store.audit(), "statement") == [("new",)]
    later = at(9, 12).replace(month=6)
    assert store.apply_retention(later) == ["2024-03-09"]
    assert store.audit().count() == 0 and store.logins().count() == 0


def test_parts_of_one_file_in_any_order(spark, tmp_path):
    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    parts = [(10, statement_xml(20, at(1, 2), 60, "a")), (5, login_xml(2, at(1, 1), 60, "ann", "10.0.0.1", "app"))]
    for offset, xml in parts:
        spark.createDataFrame([("T_0_1.xml", offset, xml)], RAW_EVENT).coalesce(1).write.mode("append").parquet(incoming)
        audit_stream(spark, incoming, store).awaitTermination()
    assert rows(store.audit(), "statement", "client_net_address") == [("a", "10.0.0.1")]
    assert store.checkpoints().count() == 2
    assert rows(store.log(), "msg") == [("Audit stream started",)] * 2


def test_spared_logins_serve_late_files(spark, tmp_path):
    incoming = str(tmp_path / "in")
    store = AuditStore(spark, str(tmp_path / "store"), AuditConfig(keep_open_sessions=True))
    deliver(spark, incoming, "T_0_1.xml", [login_xml(2, at(1, 1), 60, "ann", "10.0.0.1", "app"), login_xml(3, at(1, 1), 61, "bob", "h", "b")])
    audit_stream(spark, incoming, store).awaitTermination()
    deliver(spark, incoming, "T_0_3.xml", [statement_xml(30, at(20, 1).replace(month=5), 60, "late user")])
    audit_stream(spark, incoming, store).awaitTermination()
    store.apply_retention(at(20, 2).replace(month=5))
    assert store.logins().count() == 2 and store.checkpoints().count() == 2
    deliver(spark, incoming, "T_0_2.xml", [login_xml(20, at(19, 1).replace(month=5), 62, "eve", "e", "e")])
    audit_stream(spark, incoming, store).awaitTermination()
    assert rows(store.audit(), "statement", "client_net_address") == [("late user", "10.0.0.1")]


def test_log_names_lost_files_and_is_purged(spark, tmp_path):
    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    deliver(spark, incoming, "T_0_1.xml", [statement_xml(1, at(1, 2), 60, "a")])
    audit_stream(spark, incoming, store).awaitTermination()
    store.note_lost_files(spark.createDataFrame([("/x/T_0_1.xml",)], "path string"))
    store.note_lost_files(spark.createDataFrame([("/x/T_0_2.xml",)], "path string"))
    assert rows(store.log(), "msg") == [("Audit stream started",), ("Lost audit file: T_0_1.xml",)]
    store.apply_retention(at(1).replace(year=2099))
    assert store.log().count() == 0 and store.checkpoints().count() == 1
    with pytest.raises(ValueError):
        audit_stream(spark, incoming, AuditStore(spark, str(tmp_path / "s2"), AuditConfig(keep_raw=True)), format="xml")


def test_a_late_login_changes_its_interval_only(spark, tmp_path):
    # Sessions 60 and 61, statements at 10, 20, ... of five days; a file of the second day comes last.
    files = {}
    for day in range(1, 6):
        events = [login_xml(1, at(1), 62, "eve", "e", "e")] if day == 1 else []
        for n in range(1, 6):
            seq = 100 * day + 10 * n
            events += [statement_xml(seq + i, at(day, n), 60 + i, f"{60 + i} at {seq}") for i in range(2)]
        events += [login_xml(101 + 100 * day, at(day, 9), 60, f"user{day}", f"10.0.0.{day}", "app")] if day in (1, 4) else []
        files[f"T_0_{day}.xml"] = events
    late = [login_xml(225, at(2, 2), 60, "late", "10.0.0.99", None), statement_xml(226, at(2, 2), 60, "new one")]
    every = [(name, i, x) for name, events in [*files.items(), ("T_0_2.xml", late)] for i, x in enumerate(events)]
    want = rows(audit_batch(spark.createDataFrame(every, RAW_EVENT)).audit, *COLUMNS, "source")

    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    for name, events in files.items():
        deliver(spark, incoming, name, events)
    audit_stream(spark, incoming, store).awaitTermination()
    before = {r[:5]: r for r in rows(store.audit(), *COLUMNS, "source")}
    amended, inner = [], store._amended

    def counted(*a):
        found = inner(*a)
        amended.append(0 if found is None else found.count())
        return found

    store._amended = counted
    store._replace_from = lambda *a: pytest.fail("a login is no reason to attribute other sessions again")
    deliver(spark, incoming, "T_0_2.xml", late)
    audit_stream(spark, incoming, store).awaitTermination()
    assert rows(store.audit(), *COLUMNS, "source") == want
    # From the late login at 225 up to the next one of session 60 at 501: three of the second day, five each of the next two.
    changed = [r for r in rows(store.audit(), *COLUMNS, "source") if r[:5] in before and before[r[:5]] != r]
    assert len(changed) == 13 and {r[3] for r in changed} == {60} and {r[5] for r in changed} == {"10.0.0.99"}
    assert amended == [13]
    days = {day for day, generation in store.parts().live() if generation.startswith("repair")}
    assert days == {"2024-03-02", "2024-03-03", "2024-03-04"}


def test_random_late_logins_equal_one_batch(spark, tmp_path):
    rng = random.Random(8)
    events = {}
    for seq in range(1, 400):
        name, when = f"T_0_{seq // 50}.xml", at(1 + seq // 80, seq % 24)
        session = 60 if rng.random() < 0.4 else rng.randint(61, 66)
        address = None if rng.random() < 0.2 else f"10.0.0.{seq}"
        xml = login_xml(seq, when, session, f"u{seq}", address, rng.choice([None, "app"])) if rng.random() < 0.3 else statement_xml(seq, when, session, f"s{seq}")
        events.setdefault(name, []).append((seq, xml))
    every = [(name, seq, x) for name, own in events.items() for seq, x in own]
    live = spark.createDataFrame([(60, "p60", "h60"), (61, "p61", "h61")], LIVE_SESSIONS)
    want = rows(audit_batch(spark.createDataFrame(every, RAW_EVENT), live).audit, *COLUMNS, "source")
    store = AuditStore(spark, str(tmp_path / "store"), AuditConfig(bucket_rows=30))
    store._replace_from = lambda *a: pytest.fail("no restart is late here")
    rest = [x for x in every if x[1] != 1]
    rng.shuffle(rest)
    from tracewell.sources.trace import parse_trace_events

    parts = [[x for x in every if x[1] == 1] + rest[:60], rest[60:200], rest[200:]]
    for i, part in enumerate(parts):
        store.process(parse_trace_events(spark.createDataFrame(part, RAW_EVENT)), i, live)
    assert rows(store.audit(), *COLUMNS, "source") == want


def test_stored_statements_are_read_only_where_a_batch_may_repeat_them(spark, tmp_path, files, batch_rows):
    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    asked, inner = [], store._stored_keys
    store._stored_keys = lambda *a: asked.append(inner(*a)) or asked[-1]
    names = list(files)
    for name in [*names, names[1]]:
        deliver(spark, incoming, name, files[name])
        audit_stream(spark, incoming, store).awaitTermination()
    assert [a is None for a in asked] == [True] * len(names) + [False]
    assert rows(store.audit(), *COLUMNS) == batch_rows


@pytest.mark.parametrize("merge_every", [2, 16])
def test_login_state_grows_by_what_a_batch_brings(spark, tmp_path, monkeypatch, files, batch_rows, merge_every):
    from tracewell.sources.trace import parse_trace_events
    from tracewell.streaming import audit_stream as module

    monkeypatch.setattr(module, "MERGE_EVERY", merge_every)
    store = AuditStore(spark, str(tmp_path / "store"))
    names = list(files)
    parts = [names[i : i + 3] for i in range(0, len(names), 3)]
    for i, own in enumerate(parts):
        part = spark.createDataFrame([(name, n, x) for name in own for n, x in enumerate(files[name])], RAW_EVENT)
        for _ in range(2 if i == 1 else 1):  # one batch is run twice
            store.process(parse_trace_events(part), i)
    assert rows(store.audit(), *COLUMNS) == batch_rows
    newest = {}
    for r in store.logins().collect():
        key = (r.session_id, r.epoch)
        newest[key] = max(newest.get(key, (0,)), (r.event_sequence, r.client_net_address))
    assert {(r.session_id, r.epoch): (r.event_sequence, r.client_net_address) for r in store.login_state().collect()} == newest
    kept = sorted(p.name for p in (tmp_path / "store").glob("login_increments/version=*"))
    assert len(kept) == (len(parts) if merge_every == 16 else len(parts) % 2)
    if merge_every == 16:  # an increment holds the sessions and epochs of its batch only
        last = spark.read.parquet(str(tmp_path / "store" / "login_increments" / f"version={len(parts) - 1}"))
        assert 0 < last.count() < store.login_state().count()


def test_a_late_restart_drafts_no_statements(spark, tmp_path, monkeypatch):
    # The restart moves every statement to another epoch, so nothing said before can stand and the texts are written once.
    drafts, inner = [], stream_module.write_and_read
    monkeypatch.setattr(stream_module, "write_and_read", lambda df, *a: drafts.append(df.columns) or inner(df, *a))
    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    live = spark.createDataFrame([(61, "p1", "h1")], LIVE_SESSIONS)
    parts = [[statement_xml(7, at(1, 2), 60, "a"), statement_xml(8, at(1, 2), 61, "b")], [login_xml(1, at(1, 1), 60, "ann", "h", "app")]]
    for offset, events in enumerate(parts):
        raw = spark.createDataFrame([("T_0_1.xml", 10 - 5 * offset, x) for x in events], RAW_EVENT)
        raw.coalesce(1).write.mode("append").parquet(incoming)
        audit_stream(spark, incoming, store, live_sessions=live).awaitTermination()
    assert rows(store.audit(), "statement", "client_net_address") == [("a", "h"), ("b", "(Cur)-> h1")]
    assert [g for _, g in store.parts().live()][0].startswith("repair") and drafts
    assert not any("statement" in columns for columns in drafts)


def test_a_batch_decodes_its_logins_once(spark, tmp_path, monkeypatch):
    calls, inner = [], events_module._decoded
    monkeypatch.setattr(events_module, "_decoded", lambda flat: calls.append(1) or inner(flat))
    two = json.dumps([{"LoginName": n, "LoginTime": "2024-03-01T01:00:00", "spid": s} for n, s in (("ann \U0001f600", 60), (None, 61))])
    payloads = [two.encode("utf-16-le").hex(), "00D8", "5B0", "", "5B00\n", "3c00"]
    logins = [login_xml(i + 2, at(1, 1), 0, "", user_data=p) for i, p in enumerate(payloads)]
    flat = events_module.flatten_events(parse_trace_events(spark.createDataFrame([("T_0_1.xml", 1, x) for x in logins], RAW_EVENT)))
    bad = ["event_sequence", "user_data", "reason"]
    want = rows(events_module.decode_logins(flat), "login_name", "session_id"), rows(events_module.quarantined_logins(flat), *bad)
    assert want[0] == [("ann \U0001f600", 60)] and {r[0]: r[2] for r in want[1]} == {
        2: "login or session missing", 3: "not UTF-16LE hex", 4: "not UTF-16LE hex", 5: "not a JSON login", 6: "not UTF-16LE hex", 7: "not a JSON login"
    }
    calls.clear()
    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    deliver(spark, incoming, "T_0_1.xml", logins)
    audit_stream(spark, incoming, store).awaitTermination()
    assert (rows(store.logins(), "login_name", "session_id"), rows(store.quarantine(), *bad)) == want
    assert calls == [1]
