import io
import random

import pytest

from helpers import at, login_xml, rows, statement_xml
from tracewell.model import RAW_EVENT
from tracewell.plans.audit import audit_batch
from tracewell.sources import tail
from tracewell.streaming.audit_stream import AuditStore, audit_stream

COLUMNS = ["event_time", "epoch", "event_sequence", "session_id", "statement", "client_net_address", "source"]


def whole(text: bytes):
    """Every complete event with its place."""
    out, at_ = [], 0
    while (end := text.find(b"</event>", at_)) >= 0:
        start = max(text.rfind(b"<event ", at_, end), text.rfind(b"<event>", at_, end))
        if start >= 0:
            out.append((start, text[start : end + 8]))
        at_ = end + 8
    return out


@pytest.mark.parametrize("read_bytes", [1, 7, 8, 9, 50, 1 << 20])
def test_any_cut_gives_each_event_once(monkeypatch, read_bytes):
    monkeypatch.setattr(tail, "READ_BYTES", read_bytes)
    rng = random.Random(read_bytes)
    body = [f'<event name="{i}">{"é" * rng.randint(0, 30)}<data/></event>' for i in range(40)]
    body.insert(5, '<event name="broken off">')
    body.insert(9, " \n ")
    text = ("<events>" + "".join(body) + "</events><event name='half").encode()
    cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(25))})
    got = [x for a, b in zip(cuts, cuts[1:]) for x in tail.events_ending_in(io.BytesIO(text), a, b)]
    assert got == whole(text) and len(got) == 40


def test_batch_reads_large_files_in_ranges(spark, tmp_path):
    xml = [statement_xml(i, at(1, 1), 60, f"s{i} é") for i in range(1, 300)]
    (tmp_path / "T_0_1.xml").write_text("".join(xml))
    (tmp_path / "T_0_2.txt").write_text("".join(xml))
    (tmp_path / "sub").mkdir()
    df = tail.read_trace_tail(spark, str(tmp_path), splitBytes="5000")
    assert df.rdd.getNumPartitions() > 10 and rows(df, "event_data") == sorted((x,) for x in xml)
    assert tail.read_trace_tail(spark, str(tmp_path / "sub")).count() == 0
    offsets = [r.file_offset for r in df.orderBy("file_offset").collect()]
    assert offsets == [o for o, _ in whole((tmp_path / "T_0_1.xml").read_bytes())]


def test_growing_files_are_complete_in_the_audit(spark, tmp_path):
    folder = tmp_path / "trace"
    folder.mkdir()
    events = {f"T_0_{d}.xml": [x for n in range(8) for x in (
        login_xml(100 * d + 2 * n + 1, at(d, n), 60 + n % 3, f"u{n}", f"10.{d}.0.{n}", "app"), statement_xml(100 * d + 2 * n + 2, at(d, n), 60 + n % 2, f"{d} {n} é"))]
        for d in (1, 2, 3)}
    events["T_0_1.xml"].insert(0, statement_xml(1, at(1), 60, "first"))
    store = AuditStore(spark, str(tmp_path / "store"))
    store._replace_from = lambda *a: pytest.fail("growth in order is not late")
    text = {n: "".join(x).encode() for n, x in events.items()}
    # The first file grows in three steps, cut inside events; the others come while it is there.
    steps = [{"T_0_1.xml": 300}, {"T_0_1.xml": 1777}, {"T_0_1.xml": None, "T_0_2.xml": 901}, {"T_0_2.xml": None, "T_0_3.xml": None}, {}]
    counts = []
    for step in steps:
        for name, size in step.items():
            (folder / name).write_bytes(text[name][:size])
        audit_stream(spark, str(folder), store, format="trace_tail").awaitTermination()
        counts.append(store.audit().count())
    every = [(n, i, x) for n, own in events.items() for i, x in enumerate(own)]
    assert rows(store.audit(), *COLUMNS) == rows(audit_batch(spark.createDataFrame(every, RAW_EVENT)).audit, *COLUMNS)
    assert counts == sorted(counts) and counts[0] < counts[1] < counts[2] and counts[3] == counts[4] == 25


def test_offset_holds_open_files_only(tmp_path):
    for i in range(9):
        (tmp_path / f"T_0_{i}.xml").write_text("<event >x</event>" * (i + 1))
    files = tail._Files({"path": str(tmp_path), "openfiles": "3"})
    reader = tail._TailReader(files)
    end = reader.latestOffset()
    assert end["finished"] == "T_0_5.xml" and list(end["open"]) == ["T_0_6.xml", "T_0_7.xml", "T_0_8.xml"]
    parts = reader.partitions(reader.initialOffset(), end)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 45
    (tmp_path / "T_0_7.xml").write_text("<event >x</event>" * 10)
    (tmp_path / "T_0_9.xml").write_text("<event >x</event>")
    for i in range(6):
        (tmp_path / f"T_0_{i}.xml").unlink()
    after = reader.latestOffset()
    assert after["finished"] == "T_0_6.xml"
    assert sum(b.num_rows for p in reader.partitions(end, after) for b in reader.read(p)) == 2 + 1
    assert reader.partitions(after, reader.latestOffset()) == []
    with pytest.raises(ValueError):
        tail._Files({})
