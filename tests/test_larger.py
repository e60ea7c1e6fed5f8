"""Faults that show only when tables, files or numbers are larger than those of the smallest scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from helpers import plan, rows
from tracewell.operators import analytics
from tracewell.plans import patterns
from tracewell.streaming.audit_stream import _STORED_AUDIT, AuditStore
from tracewell.workload import analysis_queries, trace_view


def test_numbered_statements_of_six_digits(spark, tmp_path):
    ids = [0, 5, 99_998, 99_999, 100_000, 100_001, 1_234_567]
    events = [(i, dt.datetime(2024, 1, 1, 0, 0, n), 7, "click" if n % 2 else "view", 1.0, '{"k": 1}') for n, i in enumerate(ids)]
    made = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    made.write.parquet(f"{tmp_path}/events.parquet")
    got = analysis_queries.numbered_statement_gaps(spark, str(tmp_path))
    assert sorted(rows(got)) == [(5, 7, 6, 1), (99_998, 7, 99_999, 6), (1_234_567, 7, 1_234_568, 100_002)]


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_trace_files_are_written_row_by_row(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda *a, **k: pytest.fail("a whole file in one group"))
    events = [(f"T_0_{n % 3}.xml", n // 7, f'<action name="event_sequence"><value>{n}</value></action>é') for n in range(200)]
    raw = spark.createDataFrame(events, "file_name string, file_offset long, event_data string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        trace_view.write_trace_files(raw, f"file://{tmp_path}/out", share)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        whole = "".join(x for name, _, x in events if name == f"T_0_{k}.xml").encode()
        assert (tmp_path / "out" / f"T_0_{k}.xml").read_bytes() == whole[: int(len(whole) * share)]


def test_many_patterns_of_like_numbers_meet_their_own_texts_only(spark, monkeypatch):
    like = []
    monkeypatch.setattr(patterns, "materialise", lambda df, label: like.append(df.persist()) or like[-1], raising=False)
    texts = spark.range(2000).selectExpr("id", "concat('SELECT x /* by ', 1000000 + id * 97, ' */') AS t")
    made = spark.range(200_000).selectExpr("id AS j", "concat('%by ', 1000000 + id, ' *_') AS p")
    assert patterns.pattern_join(texts, "t", made, "p").count() == 2000
    shared = like[0].groupBy("__gram").count().agg(F.max("count")).first()[0] if like else None
    assert shared is not None and shared <= 2
    fits = patterns._fits(like[0])(8)
    grams = texts.select(F.explode(F.filter(patterns._grams(F.lower("t"), 8), fits)).alias("g"))
    assert 2000 <= grams.count() <= 8000
    like[0].unpersist()


def test_event_trace_map_is_distinct_before_its_joins(spark):
    def made(rows_, schema):
        return spark.createDataFrame(rows_ * 2, schema)

    got = analytics.event_trace_map(
        made([(1, "A"), (1, "A2"), (2, "B"), (3, "C"), (4, "C"), (None, "N")], "trace_event_id int, name string"),
        made([(1, "p", "xa"), (1, "p", None), (2, "p", "xb"), (None, "q", "x")], "trace_event_id int, package_name string, xe_event_name string"),
        made([(1, 10), (1, None), (1, 12), (3, 10), (None, 10)], "trace_event_id int, trace_column_id int"),
        made([(10, "c"), (10, "d"), (None, "e")], "trace_column_id int, name string"),
        made([(10, None), (10, "act")], "trace_column_id int, xe_action_name string"),
    )
    want = {(1, k, "p", x, *rest) for k in ("A", "A2") for x in ("xa", None) for rest in
            [(10, n, a) for n in "cd" for a in (None, "act")] + [(None, None, None), (12, None, None)]}
    want |= {(None, "B", "p", "xb", None, None, None), (None, "C", None, None, None, None, None), (None, "N", None, None, None, None, None)}
    assert rows(got) == sorted(want, key=repr)
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan(got))
    assert keys and not any("extended_events_action" in k and "event_class" in k for k in keys)


def test_packing_is_dealt_by_the_size_of_rows(spark, tmp_path):
    # Texts that compress to almost nothing: by the size of their files they would all be one task.
    own = {"server_principal_name": "concat('u', id % 9)", "statement": "repeat('x', 1000)", "event_sequence": "id", "event_date": "DATE '2024-01-01'"}
    cells = [f"CAST({own.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in _STORED_AUDIT]
    rows_ = spark.range(10_000).selectExpr(*cells)
    store = AuditStore(spark, str(tmp_path / "store"))
    for half in (0, 1):
        store.parts().append(rows_.where(f"event_sequence % 2 = {half}"), f"half-{half}")
    assert store.compact(dt.date(2100, 1, 1), bytes_per_task=2 << 20) == ["2024-01-01"]
    assert 4 <= len(store.parts().read().inputFiles()) <= 12
    assert rows(store.audit(), "event_sequence") == sorted(((n,) for n in range(10_000)), key=repr)
