import datetime as dt
import random
import re

import pytest

from helpers import plan, rows
from tracewell.plans import intervals, patterns
from tracewell.plans.intervals import interval_join
from tracewell.plans.patterns import pattern_join


def inside(p, a, b, closed):
    return (a is None or p > a or (p == a and closed in ("left", "both"))) and (b is None or p < b or (p == b and closed in ("right", "both")))


KINDS = {
    "long": lambda n: n,
    "double": lambda n: n / 7,
    "date": lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n),
    "timestamp_ntz": lambda n: dt.datetime(2024, 3, 9) + dt.timedelta(minutes=11 * n),
}


@pytest.mark.parametrize("kind, closed", [("long", "right"), ("long", "neither"), ("double", "both"), ("date", "left"), ("timestamp_ntz", "right")])
def test_interval_join_equals_every_pair(spark, kind, closed):
    rng = random.Random(kind + closed)
    of = KINDS[kind]
    points = [(i, rng.choice([1, 2, None]), of(rng.randint(-200, 1500)) if rng.random() > 0.05 else None) for i in range(200)]
    bounds = []
    for i in range(80):
        a = rng.randint(-300, 1600)
        b = a + rng.choice([-5, 0, 1, 2, 3, 10, 40, 5000])
        bounds.append((i, rng.choice([1, 2, None]), None if rng.random() < 0.08 else of(a), None if rng.random() < 0.08 else of(b)))
    left = spark.createDataFrame(points, f"p int, k int, at {kind}")
    right = spark.createDataFrame(bounds, f"i int, k int, a {kind}, b {kind}")
    for by in ([], ["k"]):
        ours = right if by else right.drop("k")
        got = interval_join(left, ours, "at", "a", "b", by=by, closed=closed, share_points=5)
        want = [(p, i) for p, k, at in points for i, l, a, b in bounds if at is not None and inside(at, a, b, closed) and (not by or (k is not None and k == l))]
        assert rows(got, "p", "i") == sorted(want, key=repr)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_interval_join_of_nothing(spark):
    left, right = spark.createDataFrame([], "at int"), spark.createDataFrame([(1, 2), (None, None)], "a int, b int")
    assert interval_join(left, right, "at", "a", "b").count() == 0
    assert interval_join(spark.createDataFrame([(1,)], "at int"), right.limit(0), "at", "a", "b").count() == 0
    assert rows(interval_join(spark.createDataFrame([(2,), (None,)], "at int"), right, "at", "a", "b")) == [(2, 1, 2), (2, None, None)]
    with pytest.raises(ValueError):
        interval_join(left, right, "at", "a", "b", closed="up")


def test_long_intervals_take_few_rows(spark):
    right = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(0, 10**9)], "a long, b long")
    got = interval_join(spark.range(100).toDF("at"), right, "at", "a", "b")
    assert got.where("b = 1000000000").count() == 99 and got.count() == 99 + 50
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in text and intervals.STEP == 8


def like(text, pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, text, re.S) is not None


@pytest.mark.parametrize("ignore_case", [True, False])
def test_pattern_join_equals_every_pair(spark, ignore_case):
    rng = random.Random(3)
    letters = "abcAB%_ é\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "", "a", "abcabcabc"]
    made = ["".join(rng.choice("abcA%_%é") for _ in range(rng.randint(0, 9))) for _ in range(250)]
    made += ["", "%", "_", "__", "%_", "a", "%a%", "\\%%", "%\\_%", "\\%", "\\_\\_", None, "abcabcabc", "%abcabc%", "zzzz%", "%\\\\%"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    right = spark.createDataFrame([(i, p) for i, p in enumerate(made)], "j int, p string")
    got = pattern_join(left, "t", right, "p", ignore_case)
    fold = str.lower if ignore_case else str
    want = [(i, j) for i, t in enumerate(texts) for j, p in enumerate(made) if t is not None and p is not None and like(fold(t), fold(p))]
    assert rows(got, "i", "j") == sorted(want, key=repr)
    assert got.columns == ["i", "t", "j", "p"] and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert pattern_join(left, "t", right.limit(0), "p").count() == 0 and pattern_join(left.limit(0), "t", right, "p").count() == 0


def test_a_hundred_thousand_patterns(spark):
    texts = spark.range(2000).selectExpr("id", "concat('user_', id, ' read table_', id * 37, ' of db') AS t")
    made = spark.range(100_000).selectExpr("id AS j", "concat('%table_', id * 37, ' %') AS p")
    got = pattern_join(texts, "t", made, "p")
    assert got.count() == 2000 and got.where("id <> j").count() == 0
    assert patterns.GRAM == 4
