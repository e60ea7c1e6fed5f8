import datetime as dt

import pyarrow.parquet as pq

from helpers import at, login_xml, rows, statement_xml
from tracewell.model import RAW_EVENT
from tracewell.sources.generations import Generations
from tracewell.sources.trace import parse_trace_events
from tracewell.streaming import audit_stream as module
from tracewell.streaming.audit_stream import AuditStore


def test_readers_see_a_change_whole_or_not(spark, tmp_path):
    schema = spark.createDataFrame([], "v int, d date").schema
    table = Generations(spark, str(tmp_path / "t"), schema, "d")
    day = [dt.date(2024, 3, i) for i in range(1, 4)]

    def of(*pairs):
        return spark.createDataFrame([(v, day[i]) for v, i in pairs], schema)

    assert table.read().count() == 0 and table.values() == []
    table.append(of((1, 0), (2, 1)), "a")
    table.append(of((3, 1), (4, 2)), "b")
    assert rows(table.read(), "v") == [(1,), (2,), (3,), (4,)] and table.generations("2024-03-02") == 2
    table.append(of((3, 1), (5, 2)), "b")  # the same label again: what it added before is taken back
    assert rows(table.read(), "v") == [(1,), (2,), (3,), (5,)]
    held = table.read()  # a reader from before the next changes
    table.replace(of((9, 1)), "r", ["2024-03-03"])
    assert rows(table.read(), "v") == [(1,), (9,)] and rows(held, "v") == [(1,), (2,), (3,), (5,)]
    # A write that was broken off shows nothing.
    of((7, 0)).write.partitionBy("d").parquet(str(tmp_path / "t" / "generation=half.9"))
    assert rows(table.read(), "v") == [(1,), (9,)]
    table.drop(["2024-03-01"])
    assert rows(table.read()) == [(9, day[1])] and rows(table.read(["2024-03-01"])) == []
    assert table.vacuum() == 7 and rows(table.read(), "v") == [(9,)]
    assert len(list((tmp_path / "t" / "_live").glob("[0-9]*"))) == 1
    table.take_back("r")
    assert table.read().count() == 0


def test_packed_dates_are_few_files_and_found_by_user(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(module.PACKED, "parquet.block.size", "20000")
    store = AuditStore(spark, str(tmp_path / "store"))
    columns = ["event_time", "event_sequence", "server_principal_name", "statement", "client_net_address"]
    for batch in range(4):
        events = [(f"T_0_{batch}.xml", 0, login_xml(10_000 * batch + 1, at(1), 60, "ann", f"10.0.0.{batch}", "app"))]
        for i in range(2, 500):
            user = f"user{(i * 7919) % 100:03d}"
            xml = statement_xml(10_000 * batch + i, at(1 + batch % 2, i % 24), 60, f"{i} " + "x" * (i % 50), user=user)
            events.append((f"T_0_{batch}.xml", i, xml))
        store.process(parse_trace_events(spark.createDataFrame(events, RAW_EVENT)), batch)
    before = rows(store.audit(), *columns)
    assert store.compact(dt.date(2024, 3, 2)) == ["2024-03-01"] and store.compact(dt.date(2024, 3, 2)) == []
    reader = store.audit()
    assert store.compact(dt.date(2024, 4, 1)) == ["2024-03-02"]
    assert rows(reader, *columns) == rows(store.audit(), *columns) == before
    assert store.vacuum() > 0 and rows(store.audit(), *columns) == before
    files = sorted((tmp_path / "store" / "audit").rglob("*.parquet"))
    assert len(files) <= 4
    groups = met = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at_ = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)].index("server_principal_name")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at_).statistics
            groups += 1
            met += stats.min <= "user042" <= stats.max
    assert groups >= 8 and met <= groups / 3  # a look-up by user reads a small share
    # A batch that is run again, and a late login, work on packed dates as on others.
    late = [("T_0_0.xml", 600, login_xml(300, at(1, 1), 60, "late", "10.9.9.9", "app"))]
    store.process(parse_trace_events(spark.createDataFrame(late, RAW_EVENT)), 4)
    assert store.audit().where("client_net_address = '10.9.9.9'").count() == 199 and store.audit().count() == len(before)
