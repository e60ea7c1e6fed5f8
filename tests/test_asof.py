import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from tracewell.operators.attribution import attribute_asof, attribute_with_fallback
from tracewell.plans.asof import asof_attribute, previous_value

E1, E2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)
STATEMENT = "session_id int, epoch timestamp, event_sequence long"
LOGIN = STATEMENT + ", client_net_address string, client_app_name string"
LIVE = "session_id int, program_name string, client_net_address string"


@pytest.fixture(scope="module")
def random_trace(spark):
    rng = random.Random(7)
    events = []
    for epoch in (E1, E2, dt.datetime(2024, 1, 9)):
        for seq in range(1, 400):
            # Session 1 holds a third of everything.
            session = 1 if rng.random() < 1 / 3 else rng.randint(2, 9)
            events.append((None if rng.random() < 0.02 else session, epoch, seq, rng.random() < 0.15))
    logins = [(s, e, q, f"a{q}" if q % 7 else None, f"p{q}") for s, e, q, login in events if login]
    statements = [(s, e, q) for s, e, q, login in events if not login]
    return statements, logins


@pytest.mark.parametrize("bucket_rows", [1, 3, 50, 1_000_000])
def test_equals_brute_force(spark, random_trace, bucket_rows):
    statements, logins = random_trace
    expected = []
    for s, e, q in statements:
        before = [x for x in logins if s is not None and x[0] == s and (x[1], x[2]) < (e, q)]
        hit = max(before, key=lambda x: (x[1], x[2])) if before else None
        expected.append((s, e, q, hit and hit[3], hit and hit[4]))
    got = attribute_asof(
        spark.createDataFrame(statements, STATEMENT), spark.createDataFrame(logins, LOGIN), bucket_rows
    )
    assert rows(got) == sorted(expected, key=repr)


def test_edges_and_fallback(spark):
    statements = [(7, E1, 15), (7, E1, 25), (7, E2, 3), (8, E1, 1), (None, E1, 5), (9, E1, 9), (7, E1, 10), (5, E1, 9)]
    logins = [(7, E1, 10, "A", "a"), (7, E1, 20, "B", "b"), (9, E1, 2, None, "n"), (None, E1, 1, "Z", "z"), (5, E1, 2, "C", None)]
    live = [(8, "p8", "h8"), (8, "p7", "h7"), (9, "p9", "h9"), (5, "p5", "h5")]
    for bucket_rows in (1, 4, 1_000_000):
        got = attribute_with_fallback(
            spark.createDataFrame(statements, STATEMENT),
            spark.createDataFrame(logins, LOGIN),
            spark.createDataFrame(live, LIVE),
            bucket_rows,
        )
        assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == {
            (7, E1, 15): ("A", "a", "asof"),
            (7, E1, 25): ("B", "b", "asof"),
            (7, E2, 3): ("B", "b", "asof"),  # only a login of the epoch before, with a higher sequence
            (7, E1, 10): ("session is gone", "Client program disconnected", "none"),  # never its own login
            (8, E1, 1): ("(Cur)-> h8", "(Cur)-> p8", "live"),  # two live rows do not double it
            (None, E1, 5): ("session is gone", "Client program disconnected", "none"),
            (9, E1, 9): ("(Cur)-> h9", "n", "live"),  # program from the login, address from the live view
            (5, E1, 9): ("C", "Client program disconnected", "asof"),  # live view not asked: address known
        }


def test_drop_repeats(spark):
    statements = [(7, E1, 15), (7, E1, 15), (7, E1, 16), (7, None, 3), (7, None, 3)]
    got = attribute_with_fallback(
        spark.createDataFrame(statements, STATEMENT),
        spark.createDataFrame([(7, E1, 10, "A", "a")], LOGIN),
        spark.createDataFrame([], LIVE),
        drop_repeats=True,
    )
    # A NULL in the key equals nothing: such rows are never taken for copies.
    assert rows(got, "epoch", "event_sequence") == sorted([(E1, 15), (E1, 16), (None, 3), (None, 3)], key=repr)


def test_not_strict(spark):
    left = spark.createDataFrame([(1, E1, 5)], STATEMENT)
    right = spark.createDataFrame([(1, E1, 5, "x")], STATEMENT + ", v string").withColumn("p", F.struct("v")).drop("v")
    for strict, expected in ((True, None), (False, "x")):
        out = asof_attribute(left, right, "session_id", "epoch", "event_sequence", "p", strict=strict)
        assert out.select("p.v").first()[0] == expected


def test_plan_moves_the_statements_once(spark, tmp_path):
    statements = spark.range(1000).selectExpr(
        "cast(id % 7 as int) session_id", "timestamp_seconds(0) epoch", "id event_sequence", "repeat('x', 100) statement"
    )
    statements.write.parquet(f"{tmp_path}/s")
    logins = spark.createDataFrame([(7, E1, 10, "A", "a")], LOGIN)
    live = spark.createDataFrame([(8, "p8", "h8")], LIVE)
    got = attribute_with_fallback(spark.read.parquet(f"{tmp_path}/s"), logins, live, drop_repeats=True)
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text
    # The wide scan sits under exactly one exchange; the other scan of the table reads key columns only.
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert sum("statement:string" in line for line in scans) == 1 and len(scans) == 2
    wide = next(i for i, line in enumerate(text.splitlines()) if "FileScan" in line and "statement:string" in line)
    depth = len(text.splitlines()[wide]) - len(text.splitlines()[wide].lstrip(" :+-"))
    exchanges, level = 0, depth
    for line in reversed(text.splitlines()[:wide]):
        d = len(line) - len(line.lstrip(" :+-*"))
        if d < level:
            level = d
            exchanges += "Exchange" in line
    assert exchanges == 1


@pytest.mark.parametrize("bucket_rows", [1, 4, 1000])
def test_previous_value(spark, bucket_rows):
    values = {"a": [1, 2, 4, 9, 30], "b": [5], "c": [-3, 7]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, v long")
    expected = [(k, v, ([0] + vs)[i]) for k, vs in values.items() for i, v in enumerate(vs)]
    assert rows(previous_value(df, ["g"], "v", "p", bucket_rows=bucket_rows)) == sorted(expected, key=repr)


def test_rows_without_a_sequence_are_dealt_out_and_match_nothing(spark):
    left = spark.createDataFrame([(1, 1, None, i) for i in range(500)] + [(1, 2, 5, 900)], "s int, e int, q long, id int")
    right = spark.createDataFrame([(1, 1, 3, "a")], "s int, e int, q long, v string").selectExpr("s", "e", "q", "struct(v) AS p")
    live = spark.createDataFrame([(1, "host")], "s int, live string")
    got = asof_attribute(left, right, by="s", epoch="e", seq="q", payload="p", per_key=live).collect()
    assert len(got) == 501 and {r.live for r in got} == {"host"}
    assert [r.id for r in got if r.p is not None] == [900]
