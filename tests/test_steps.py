import datetime as dt
import random

import pytest

from helpers import plan, rows
from tracewell.operators.epochs import assign_epoch
from tracewell.plans import steps as s


def plain(keys, marks, default):
    out = []
    for k in keys:
        below = [(a, v) for a, v in marks if k is not None and a is not None and v is not None and a <= k]
        out.append((k, max(below)[1] if below else default))
    return sorted(out, key=repr)


def texts(rng, n):
    return ["T_0_" + "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 9))) + ".xml" for _ in range(n)]


KEYS = {
    "string": texts,
    "long": lambda rng, n: [rng.randint(-5, 10 ** rng.randint(1, 12)) for _ in range(n)],
    "timestamp_ntz": lambda rng, n: [dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randint(0, 60_000)) for _ in range(n)],
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("cells", [(1, 1), (3, 1), (6, 3)])
def test_equals_the_greatest_start_below(spark, monkeypatch, kind, cells):
    monkeypatch.setattr(s, "CELL_LENGTH", cells[0])
    monkeypatch.setattr(s, "RANGE_LENGTH", cells[1])
    rng = random.Random(kind + str(cells))
    keys = [*KEYS[kind](rng, 150), None, None]
    marks = [(k, rng.choice([None, 1, 2, 3])) for k in [*rng.sample(keys[:-2], 20), *KEYS[kind](rng, 40)]] + [(None, 9)]
    got = s.step_lookup(
        spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, id int"),
        "k",
        spark.createDataFrame(marks, f"a {kind}, v int"),
        "a",
        "v",
        "out",
        default=-1,
    )
    assert rows(got, "k", "out") == plain(keys, marks, -1)
    none = s.step_lookup(spark.createDataFrame([(keys[0],)], f"k {kind}"), "k", spark.createDataFrame([], f"a {kind}, v int"), "a", "v", "out", -1)
    assert rows(none) == [(keys[0], -1)]


def test_no_task_orders_all_keys(spark):
    events = spark.range(100).selectExpr("concat('T_0_', id, '.xml') file_name", "id % 7 event_sequence", "timestamp_seconds(id) event_time")
    text = plan(assign_epoch(events))
    assert "Window" in text
    # Nothing meets in one task but an array of the last steps of each range, one partial a task.
    single = [line for line in text.splitlines() if "SinglePartition" in line]
    below = [text.splitlines()[text.splitlines().index(line) + 1] for line in single]
    assert all("partial_collect_list" in line for line in below) and len(single) <= 1
    assert text.count("Exchange ") <= 8
    with pytest.raises(ValueError):
        from tracewell.plans.asof import asof_join

        asof_join(events, events, [], ["file_name"], ["event_sequence"], "event_time")
