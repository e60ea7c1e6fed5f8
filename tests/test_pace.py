import time

from helpers import at, login_xml, rows, statement_xml
from tracewell.model import RAW_EVENT
from tracewell.streaming.audit_stream import AuditStore, audit_stream
from tracewell.streaming.pace import Pace


def deliver(spark, incoming, name, events):
    raw = spark.createDataFrame([(name, i, x) for i, x in enumerate(events)], RAW_EVENT)
    raw.coalesce(1).write.mode("append").parquet(incoming)


def until(met, seconds=60):
    end = time.time() + seconds
    while not met() and time.time() < end:
        time.sleep(0.3)
    assert met()


def test_a_stream_waits_after_small_batches_and_tells_silence(spark, tmp_path):
    incoming, store, waits = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store")), []
    deliver(spark, incoming, "T_0_1.xml", [login_xml(1, at(1), 60, "ann", "h", "a"), *(statement_xml(i, at(1, 1), 60, f"s{i}") for i in range(2, 7))])
    pace = Pace(quiet_rows=3, quiet_seconds=7, silent_seconds=1, wait=waits.append)
    query = audit_stream(spark, incoming, store, processing_time="300 milliseconds", pace=pace)
    try:
        until(lambda: any(m[0].startswith("No events since") for m in rows(store.log(), "msg")))
        assert store.audit().count() == 5 and waits == []  # five statements are not few here
        deliver(spark, incoming, "T_0_2.xml", [statement_xml(9, at(1, 2), 60, "one")])
        until(lambda: ("Events come again",) in rows(store.log(), "msg"))
        until(lambda: sum(m[0].startswith("No events since") for m in rows(store.log(), "msg")) == 2)
    finally:
        query.stop()
    assert waits == [7]
    assert rows(store.progress(), "statements") == [(1,), (5,)]


def test_a_run_that_ends_keeps_no_pace(spark, tmp_path):
    incoming, store = str(tmp_path / "in"), AuditStore(spark, str(tmp_path / "store"))
    deliver(spark, incoming, "T_0_1.xml", [statement_xml(2, at(1, 1), 60, "a")])
    audit_stream(spark, incoming, store, pace=Pace(wait=lambda s: 1 / 0)).awaitTermination()
    assert rows(store.progress(), "statements", "file_name") == [(1, "T_0_1.xml")]
