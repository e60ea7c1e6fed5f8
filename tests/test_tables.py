import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from helpers import at, plan, rows
from tracewell.model import CHECKPOINT
from tracewell.operators import lifecycle, migrate
from tracewell.session import materialise, work_dir
from tracewell.sources import tables
from tracewell.sources.trace import latest_trace_file, list_trace_files, next_events, pending_events

EVENTS = "file_name string, file_offset long"


def checkpoint(spark, *done):
    return spark.createDataFrame([(f, o, at(1, h), None) for h, (f, o) in enumerate(done)], CHECKPOINT)


def test_listing_ignores_other_files_and_subfolders(spark, tmp_path):
    for name in ("T_0_1.xml", "T_0_2.xml", "notes.xml"):
        (tmp_path / name).write_text("x")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "T_0_0.xml").write_text("x")
    files = list_trace_files(spark, str(tmp_path), "*.xml")
    names = [r.path.rsplit("/", 1)[1] for r in files.orderBy("path").collect()]
    assert names == ["T_0_1.xml", "T_0_2.xml"]
    assert "content" not in plan(files)
    assert latest_trace_file(files).first()[0].endswith("T_0_2.xml")


def test_pending_and_next(spark):
    events = spark.createDataFrame([("f1", 1), ("f1", 2), ("f1", 2), ("f2", 1), ("f3", 1)], EVENTS)
    none = checkpoint(spark)
    assert rows(next_events(events, none)) == [("f1", 1), ("f1", 2), ("f1", 2)]
    assert pending_events(events, none).count() == 5
    inside, end = checkpoint(spark, ("f1", 1)), checkpoint(spark, ("f1", 1), ("f1", 2))
    assert rows(next_events(events, inside)) == [("f1", 2), ("f1", 2)]
    assert rows(next_events(events, end)) == [("f2", 1)]
    assert rows(pending_events(events, end)) == [("f2", 1), ("f3", 1)]
    assert rows(pending_events(events, start=("f2", 0))) == [("f2", 1), ("f3", 1)]
    assert next_events(events, checkpoint(spark, ("f3", 9))).count() == 0


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "event_date date, k int, v string"
    day = dt.date(2024, 3, 1)
    first = spark.createDataFrame([(day, 1, "a"), (day, None, "n")], schema)
    second = spark.createDataFrame([(day, 1, "other"), (dt.date(2024, 3, 2), 2, "b")], schema)
    tables.append_new(first, path, ["event_date", "k"], partition_by="event_date")
    tables.append_new(second, path, ["event_date", "k"], partition_by="event_date", rebalance=True)
    tables.append_new(second, path, ["event_date", "k"], partition_by="event_date")
    assert rows(spark.read.parquet(path), "k", "v") == sorted([(1, "a"), (None, "n"), (2, "b")], key=repr)
    tables.append_new(first, path, ["event_date", "k"], partition_by="event_date")
    assert spark.read.parquet(path).where("k is null").count() == 2  # NULL equals nothing


def test_checkpoint_and_log_and_capture(spark, tmp_path):
    batch = spark.createDataFrame([("f1", 1), ("f1", 7)], EVENTS)
    row = tables.batch_checkpoint(batch, at=at(1))
    assert rows(row) == [("f1", 7, at(1), None)]
    assert tables.batch_checkpoint(batch, checkpoint(spark, ("f1", 7))).count() == 0
    assert tables.batch_checkpoint(batch.limit(0)).count() == 0
    tables.log_messages(spark.createDataFrame([("hello",)], "msg string"), str(tmp_path / "log"), at=at(2))
    assert rows(spark.read.parquet(str(tmp_path / "log"))) == [(at(2), "hello")]
    for _ in range(2):
        tables.capture_raw(batch, str(tmp_path / "raw"), 3)
    assert rows(spark.read.parquet(str(tmp_path / "raw"))) == [("f1", 1, 3), ("f1", 7, 3)]


def test_purge_drops_partitions_and_splits_one(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(at(d, h),) for d in (1, 2, 3) for h in (1, 13)] + [(None,)], "event_time timestamp")
    df.withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(path)
    assert tables.purge_before(spark, path, at(2, 12), "event_time", "event_date") == ["2024-03-01"]
    left = [r[0] for r in spark.read.parquet(path).select("event_time").collect()]
    assert sorted(x for x in left if x) == [at(2, 13), at(3, 1), at(3, 13)] and None in left


def test_materialise_and_work_dir(spark):
    df = materialise(spark.range(5).withColumn("p", F.col("id") % 2), "t", partition_by="p")
    assert df.count() == 5 and df.columns == ["id", "p"]
    assert work_dir(session({"spark.checkpoint.dir": "/shared/"}, "yarn")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session({}, "yarn"))  # never a folder only one machine sees


def session(conf, master):
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))


def test_prune_and_retention(spark):
    logins = spark.createDataFrame(
        [(7, at(1), 1, at(1)), (7, at(1), 5, at(2)), (7, at(1), 3, at(1)), (7, at(9), 2, at(9)), (8, at(1), 4, at(1))],
        "session_id int, epoch timestamp, event_sequence long, login_time timestamp",
    )
    assert rows(lifecycle.prune_connections(logins), "session_id", "epoch", "event_sequence") == [
        (7, at(1), 5), (7, at(9), 2), (8, at(1), 4)
    ]
    # All epochs expired: the newest one stays by the epoch rule.
    far = at(9) + dt.timedelta(days=100)
    assert rows(lifecycle.retain_epochs(logins, far), "epoch") == [(at(9),)]
    assert lifecycle.retain_connections(logins, far).count() == 0
    kept = lifecycle.retain_connections(logins, far, keep_open_sessions=True)
    assert rows(kept, "session_id", "event_sequence") == [(7, 2)]
    report = lifecycle.epoch_retention_report(logins, far)
    assert rows(report, "epoch", "session_history_rank", "kept") == [(at(1), 2, False), (at(9), 1, True)]


def test_bounded_purge_takes_the_oldest(spark):
    df = spark.createDataFrame([(at(d), i) for d in (1, 2, 3) for i in (1, 2)] + [(None, 9)], "t timestamp, i int")
    now = at(2, 12)
    assert rows(lifecycle.retain(df, "t", now, days=0), "i") == [(1,), (2,), (9,)]
    once = lifecycle.retain(df, "t", now, days=0, max_rows=3, order=["i"])
    assert rows(once) == sorted([(at(2), 2), (at(3), 1), (at(3), 2), (None, 9)], key=repr)
    assert lifecycle.retain(df, "t", at(1), days=30, max_rows=3).count() == 7


@pytest.mark.parametrize("names,first", [(["f1"], []), (["f1", "f2"], [("f1", 2)])])
def test_files(spark, names, first):
    listing = spark.createDataFrame([(n,) for n in names], "path string")
    assert rows(lifecycle.disposable_files(listing)) == first
    done = checkpoint(spark, ("f0", 1), ("f1", 1), ("f2", 1))
    lost = rows(lifecycle.lost_files(done, listing))
    assert lost == ([] if "f2" in names else [("f2", "Lost audit file: f2")])
    assert ("f0", "Lost audit file: f0") in rows(lifecycle.lost_files(done, listing, latest_only=False))
    assert rows(lifecycle.finished_files(listing, done)) == [("f1",)]


def test_freshness(spark):
    audit = spark.createDataFrame([(at(1), at(1, 5)), (at(2), at(2, 5))], "epoch timestamp, event_time timestamp")
    assert rows(lifecycle.freshness(audit, at(2, 6)), "epoch", "silent") == [(at(1), False), (at(2), True)]
    assert rows(lifecycle.freshness(audit, at(2, 5)), "silent") == [(False,), (False,)]


def test_migration(spark):
    old = spark.createDataFrame(
        [("ann", at(1), 60, "s", at(1, 1), 5)],
        "server_principal_name string, event_time timestamp, session_id int, statement string, "
        "ExtendedSessionCreateTime timestamp, event_sequence long",
    )
    new = migrate.migrate_legacy_audit(old)
    got = new.first()
    assert got.epoch == at(1, 1) and got.cpu_time is None and got.statement == "s"
    assert "Exchange" not in plan(new)
    followed = spark.createDataFrame([("f", 3, at(1), 9)], "file_name string, last_Offset_done long, DateSuivi timestamp, Passe int")
    assert rows(migrate.migrate_legacy(followed, "EvenementsTraitesSuivi")) == [("f", 3, at(1), dt.datetime(2000, 1, 1))]
