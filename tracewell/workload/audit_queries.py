"""Queries on reading, dating, attributing and storing the trace."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracewell.functions.times import display_time, utc_date
from tracewell.operators import attribution, epochs, events, lifecycle
from tracewell.plans.audit import AUDIT_KEY, audit_batch
from tracewell.session import materialise, new_work_path
from tracewell.sources import tables
from tracewell.sources import trace as source
from tracewell.workload import trace_view as tv
from tracewell.workload.registry import query

_STATEMENT_COLUMNS = ["event_id", "session_id", "epoch", "event_sequence"]

_ASOF_SQL = """
  FROM statements s ASOF LEFT JOIN logins l
    ON s.session_id = l.session_id AND s.event_id > l.event_id
"""


@query(
    "asof_attribution",
    tv.TRACE_SQL
    + """
SELECT s.event_id, s.session_id, s.epoch, s.event_sequence, l.client_net_address, l.client_app_name
"""
    + _ASOF_SQL,
)
def asof_attribution(spark, sf_dir):
    trace = tv.trace(spark, sf_dir)
    statements = tv.statements(trace).select(*_STATEMENT_COLUMNS)
    return attribution.attribute_asof(statements, tv.logins(trace))


_FALLBACK = """
       coalesce(l.client_net_address, '(Cur)-> ' || c.client_net_address, 'session is gone') AS client_net_address,
       coalesce(l.client_app_name, '(Cur)-> ' || c.program_name, 'Client program disconnected') AS client_app_name,
       CASE WHEN l.client_net_address IS NOT NULL THEN 'asof'
            WHEN c.client_net_address IS NOT NULL THEN 'live' ELSE 'none' END AS source
"""
_LIVE_JOIN = " LEFT JOIN live c ON c.session_id = s.session_id AND l.client_net_address IS NULL "


@query(
    "attribution_with_fallback",
    tv.TRACE_SQL
    + "SELECT s.event_id, s.session_id, s.epoch, s.event_sequence, "
    + _FALLBACK
    + _ASOF_SQL
    + _LIVE_JOIN,
)
def attribution_with_fallback(spark, sf_dir):
    trace = tv.trace(spark, sf_dir)
    return attribution.attribute_with_fallback(
        tv.statements(trace).select(*_STATEMENT_COLUMNS), tv.logins(trace), tv.live_sessions(spark, sf_dir)
    )


@query(
    "epoch_assignment",
    tv.TRACE_SQL
    + """
, files AS (
  SELECT file_name, min(event_time) FILTER (WHERE event_sequence = 1) AS started FROM trace GROUP BY file_name
), dated AS (
  SELECT file_name, last_value(started IGNORE NULLS) OVER (ORDER BY file_name
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
  FROM files
)
SELECT t.event_id, t.file_name, t.event_sequence, d.epoch FROM trace t JOIN dated d USING (file_name)
""",
)
def epoch_assignment(spark, sf_dir):
    trace = tv.trace(spark, sf_dir).select("event_id", "file_name", "event_sequence", "event_time")
    return epochs.assign_epoch(trace).drop("event_time")


@query(
    "event_split_projection",
    tv.TRACE_SQL
    + """
SELECT event_id, session_id, event_time, CASE WHEN is_login THEN 'login' ELSE 'statement' END AS event_class,
       k, value
FROM trace WHERE session_id > 50
""",
)
def event_split_projection(spark, sf_dir):
    trace = events.user_activity(tv.trace_rows(spark, sf_dir))
    columns = ["event_id", "session_id", "event_time"]
    halves = [
        part.select(*columns, F.lit(name).alias("event_class"), "k", "value")
        for part, name in ((trace.where("is_login"), "login"), (tv.statements(trace), "statement"))
    ]
    return halves[0].unionByName(halves[1])


@query(
    "xml_statement_projection",
    tv.TRACE_SQL
    + tv.PROJECTED_SQL
    + """
SELECT file_name, event_sequence, event_time, session_id, server_principal_name, database_name, statement,
       dur_micro_sec, cpu_time, logical_reads, writes, row_count, physical_reads
FROM projected
""",
)
def xml_statement_projection(spark, sf_dir):
    flat = events.flatten_events(source.parse_trace_events(tv.raw_trace(tv.trace(spark, sf_dir))))
    out = events.extract_statements(flat)
    return out.drop("file_offset").withColumn("event_time", display_time("event_time", "UTC"))


@query(
    "login_payload_decode",
    tv.TRACE_SQL
    + """
SELECT file_name, event_sequence, event_time, 'user_' || CAST(session_id AS VARCHAR) AS login_name,
       CAST(session_id AS INTEGER) AS session_id, event_time AS login_time, client_net_address, client_app_name
FROM logins
""",
)
def login_payload_decode(spark, sf_dir):
    flat = events.flatten_events(source.parse_trace_events(tv.raw_trace(tv.trace(spark, sf_dir))))
    return (
        events.decode_logins(flat).drop("file_offset").withColumn("event_time", display_time("event_time", "UTC"))
    )


@query(
    "login_payload_enrichment",
    tv.TRACE_SQL
    + """
SELECT l.event_id, 'user_' || CAST(l.session_id AS VARCHAR) AS login_name,
       CAST(l.session_id AS INTEGER) AS session_id,
       l.client_net_address, c.program_name AS client_app_name
FROM logins l LEFT JOIN live c USING (session_id)
""",
)
def login_payload_enrichment(spark, sf_dir):
    # Encode each login with the program of its live session, then decode it again.
    logins = tv.logins(tv.trace(spark, sf_dir)).select(
        "event_id",
        "session_id",
        F.concat(F.lit("user_"), F.col("session_id")).alias("login_name"),
        F.col("event_time").alias("login_time"),
        "client_net_address",
    )
    encoded = events.login_payloads(logins, tv.live_sessions(spark, sf_dir))
    coded = encoded.select("event_id", F.lit(events.LOGIN).alias("event_class"), "user_data")
    return events.decode_logins(coded).select(
        "event_id", "login_name", "session_id", "client_net_address", "client_app_name"
    )


@query(
    "quarantined_logins",
    tv.TRACE_SQL
    + """
SELECT file_name, event_sequence, event_time,
       CASE k % 4 WHEN 0 THEN 'no payload' WHEN 1 THEN 'not UTF-16LE hex' WHEN 2 THEN 'not UTF-16LE hex'
                  ELSE 'not a JSON login' END AS reason
FROM trace WHERE event_type = 'error'
""",
)
def quarantined_logins(spark, sf_dir):
    # Errors stand for foreign user events: no payload, odd hex, no hex, and text that is not JSON.
    foreign = tv.trace(spark, sf_dir).where("event_type = 'error'")
    payload = (
        F.when(F.col("k") % 4 == 1, F.lit("5B0"))
        .when(F.col("k") % 4 == 2, F.lit("zz00"))
        .when(F.col("k") % 4 == 3, F.hex(F.encode(F.concat(F.lit("<"), F.col("k")), "UTF-16LE")))
    )
    coded = foreign.select(
        "file_name",
        "event_sequence",
        "event_time",
        F.lit(events.LOGIN).alias("event_class"),
        payload.alias("user_data"),
    )
    return events.quarantined_logins(coded).drop("user_data")


_AUDIT_SQL = (
    tv.TRACE_SQL
    + tv.PROJECTED_SQL
    + """
, started AS (SELECT epoch AS week, min(event_time) AS epoch FROM trace GROUP BY ALL)
SELECT s.server_principal_name, s.event_time, s.session_id, s.database_name, s.statement, s.event_sequence,
       s.dur_micro_sec, s.cpu_time, s.logical_reads, s.writes, s.row_count, s.physical_reads, w.epoch,
"""
    + _FALLBACK
    + """
  FROM projected s JOIN started w ON s.epoch = w.week
       ASOF LEFT JOIN logins l ON s.session_id = l.session_id AND s.event_id > l.event_id
"""
    + _LIVE_JOIN
)


def _compact_audit(audit):
    for c in ("event_time", "epoch"):
        audit = audit.withColumn(c, display_time(c, "UTC"))
    return audit.select(
        "server_principal_name", "event_time", "session_id", "database_name", "statement", "event_sequence",
        "dur_micro_sec", "cpu_time", "logical_reads", "writes", "row_count", "physical_reads", "epoch",
        "client_net_address", "client_app_name", "source",
    )


@query("audit_end_to_end", _AUDIT_SQL)
def audit_end_to_end(spark, sf_dir):
    raw = tv.raw_trace(tv.trace(spark, sf_dir))
    return _compact_audit(audit_batch(raw, tv.live_sessions(spark, sf_dir)).audit)


@query("audit_stream_append", _AUDIT_SQL)
def audit_stream_append(spark, sf_dir):
    from tracewell.streaming.audit_stream import AuditStore, audit_stream

    incoming = new_work_path(spark, "incoming")
    tv.raw_trace(tv.trace(spark, sf_dir)).write.parquet(incoming)
    store = AuditStore(spark, new_work_path(spark, "store"))
    live = materialise(tv.live_sessions(spark, sf_dir), "live")
    audit_stream(spark, incoming, store, live_sessions=live).awaitTermination()
    return _compact_audit(store.audit())


@query("audit_stream_out_of_order", _AUDIT_SQL)
def audit_stream_out_of_order(spark, sf_dir):
    # Every file arrives in three parts, each in a run of its own with parts of all others, the last events first.
    from tracewell.streaming.audit_stream import AuditStore, audit_stream

    incoming = new_work_path(spark, "incoming")
    raw = materialise(tv.raw_trace(tv.trace(spark, sf_dir)), "raw")
    store = AuditStore(spark, new_work_path(spark, "store"))
    live = materialise(tv.live_sessions(spark, sf_dir), "live")
    for part in (2, 0, 1):
        raw.where(F.floor(F.col("file_offset") / 8) == part).write.mode("append").parquet(incoming)
        audit_stream(spark, incoming, store, live_sessions=live).awaitTermination()
    return _compact_audit(store.audit())


@query("audit_stream_growing_files", _AUDIT_SQL)
def audit_stream_growing_files(spark, sf_dir):
    # Every trace file is read when it is half written, cut inside an event, and again when it is complete.
    from tracewell.streaming.audit_stream import AuditStore, audit_stream

    folder = new_work_path(spark, "growing")
    raw = materialise(tv.raw_trace(tv.trace(spark, sf_dir)), "raw")
    store = AuditStore(spark, new_work_path(spark, "store"))
    live = materialise(tv.live_sessions(spark, sf_dir), "live")
    for share in (0.5, 1.0):
        tv.write_trace_files(raw, folder, share)
        audit_stream(spark, folder, store, live_sessions=live, format="trace_tail").awaitTermination()
    return _compact_audit(store.audit())


@query(
    "login_state_by_batch",
    tv.TRACE_SQL
    + """
, started AS (SELECT epoch AS week, min(event_time) AS epoch FROM trace GROUP BY ALL)
SELECT CAST(session_id AS INTEGER) AS session_id, w.epoch, event_sequence, client_net_address
FROM logins l JOIN started w ON l.epoch = w.week
QUALIFY row_number() OVER (PARTITION BY session_id, w.epoch ORDER BY event_sequence DESC) = 1
""",
)
def login_state_by_batch(spark, sf_dir):
    # The newest login of each session and epoch, kept up to date by what each of three batches brings.
    from tracewell.streaming.audit_stream import AuditStore, audit_stream

    incoming, store = new_work_path(spark, "incoming"), AuditStore(spark, new_work_path(spark, "store"))
    raw = materialise(tv.raw_trace(tv.trace(spark, sf_dir)), "raw")
    for first, last in (("T_0_20240101", "T_0_20240110"), ("T_0_20240110", "T_0_20240120"), ("T_0_20240120", "T_1")):
        part = raw.where((F.col("file_name") >= first) & (F.col("file_name") < last))
        part.write.mode("append").parquet(incoming)
        audit_stream(spark, incoming, store).awaitTermination()
    state = store.login_state().withColumn("epoch", display_time("epoch", "UTC"))
    return state.select("session_id", "epoch", "event_sequence", "client_net_address")


_SPLIT = "TIMESTAMP '2024-01-16 12:00:00'"


@query(
    "audit_antijoin_append",
    tv.TRACE_SQL
    + f"""
SELECT event_id, event_time, epoch, event_sequence FROM statements n
WHERE NOT EXISTS (
  SELECT 1 FROM statements o WHERE o.event_time < {_SPLIT} AND o.event_time = n.event_time
    AND o.epoch = n.epoch AND o.event_sequence = n.event_sequence)
""",
)
def audit_antijoin_append(spark, sf_dir):
    # The whole trace again, against a table filled up to noon of the 16th.
    statements = tv.statements(tv.trace(spark, sf_dir)).select("event_id", *AUDIT_KEY)
    stored = statements.where(F.col("event_time") < F.expr(f"TIMESTAMP_NTZ {_SPLIT[10:]}"))
    return tables.not_stored(statements, stored, AUDIT_KEY)


@query(
    "append_new_stored",
    tv.TRACE_SQL + "SELECT event_id, event_time, epoch, event_sequence FROM statements",
)
def append_new_stored(spark, sf_dir):
    # The table holds all up to noon of the 16th; the whole trace is appended twice, and each row is there once.
    statements = tv.statements(tv.trace(spark, sf_dir)).select("event_id", *AUDIT_KEY)
    statements = materialise(statements.withColumn("event_date", utc_date("event_time")), "statements")
    path = new_work_path(spark, "appended")
    early = statements.where(F.col("event_time") < F.expr(f"TIMESTAMP_NTZ {_SPLIT[10:]}"))
    for batch in (early, statements, statements):
        tables.append_new(batch, path, AUDIT_KEY, partition_by="event_date")
    return spark.read.parquet(path).drop("event_date")


@query(
    "purge_by_partition",
    tv.TRACE_SQL + f"SELECT event_id, event_time FROM statements WHERE event_time >= {_SPLIT}",
)
def purge_by_partition(spark, sf_dir):
    statements = tv.statements(tv.trace_rows(spark, sf_dir)).select("event_id", "event_time")
    path = new_work_path(spark, "purged")
    statements.withColumn("event_date", utc_date("event_time")).write.partitionBy("event_date").parquet(path)
    tables.purge_before(spark, path, dt.datetime(2024, 1, 16, 12), "event_time", "event_date")
    return spark.read.parquet(path).drop("event_date")


def _checkpoints(trace):
    read = trace.where(F.col("event_time") < F.expr(f"TIMESTAMP_NTZ {_SPLIT[10:]}"))
    return read.groupBy("file_name").agg(
        F.max("file_offset").alias("last_offset_done"), F.max("event_time").alias("chk_point_time")
    )


_CHECKPOINT_SQL = (
    tv.TRACE_SQL
    + f"""
, checkpoints AS (
  SELECT file_name, max(file_offset) AS last_offset_done, max(event_time) AS chk_point_time
  FROM trace WHERE event_time < {_SPLIT} GROUP BY file_name
), cp AS (SELECT * FROM checkpoints ORDER BY chk_point_time DESC LIMIT 1)
, pending AS (
  SELECT t.event_id, t.file_name, t.file_offset FROM trace t, cp
  WHERE t.file_name > cp.file_name OR (t.file_name = cp.file_name AND t.file_offset > cp.last_offset_done)
)
"""
)


@query("pending_after_checkpoint", _CHECKPOINT_SQL + "SELECT * FROM pending")
def pending_after_checkpoint(spark, sf_dir):
    trace = tv.trace_rows(spark, sf_dir)
    return source.pending_events(trace.select("event_id", "file_name", "file_offset"), _checkpoints(trace))


@query(
    "next_file_events",
    _CHECKPOINT_SQL + "SELECT * FROM pending WHERE file_name = (SELECT min(file_name) FROM pending)",
)
def next_file_events(spark, sf_dir):
    trace = tv.trace_rows(spark, sf_dir)
    return source.next_events(trace.select("event_id", "file_name", "file_offset"), _checkpoints(trace))


@query(
    "batch_checkpoint",
    tv.TRACE_SQL
    + """
SELECT file_name, file_offset AS last_offset_done, max(epoch) AS epoch FROM trace GROUP BY ALL
ORDER BY file_name DESC, file_offset DESC LIMIT 1
""",
)
def batch_checkpoint(spark, sf_dir):
    trace = tv.trace_rows(spark, sf_dir)
    return tables.batch_checkpoint(trace, _checkpoints(trace)).drop("chk_point_time")


@query(
    "resume_after_batch",
    tv.TRACE_SQL
    + f"""
, done AS (
  SELECT file_name, file_offset FROM trace WHERE event_time < {_SPLIT} ORDER BY file_name DESC, file_offset DESC LIMIT 1
)
SELECT t.event_id, t.file_name, t.file_offset FROM trace t, done d
WHERE t.file_name > d.file_name OR (t.file_name = d.file_name AND t.file_offset > d.file_offset)
""",
)
def resume_after_batch(spark, sf_dir):
    # A batch of many files ends inside one, at a lower offset than its earlier files reach. All the rest is pending.
    trace = tv.trace_rows(spark, sf_dir)
    batch = trace.where(F.col("event_time") < F.expr(f"TIMESTAMP_NTZ {_SPLIT[10:]}"))
    done = tables.batch_checkpoint(batch.drop("epoch"))
    return source.pending_events(trace.select("event_id", "file_name", "file_offset"), done)


@query(
    "epoch_many_restarts",
    tv.TRACE_SQL
    + """
, named AS (
  SELECT event_id, event_time, file_offset, file_name || '_' || lpad(CAST(file_offset AS VARCHAR), 2, '0') AS file_name
  FROM trace
), hours AS (
  SELECT file_name, min(event_time) FILTER (WHERE file_offset % 3 = 0) AS started FROM named GROUP BY file_name
), dated AS (
  SELECT file_name, last_value(started IGNORE NULLS) OVER (ORDER BY file_name
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM hours
)
SELECT event_id, file_name, coalesce(epoch, TIMESTAMP '1999-12-31 00:00:00') AS epoch FROM named JOIN dated USING (file_name)
""",
)
def epoch_many_restarts(spark, sf_dir):
    # One file per hour, restarted every third hour.
    trace = tv.trace_rows(spark, sf_dir).withColumn(
        "file_name", F.concat_ws("_", "file_name", F.lpad(F.col("file_offset").cast("string"), 2, "0"))
    )
    starts = trace.where(F.col("file_offset") % 3 == 0).groupBy("file_name").agg(F.min("event_time").alias("epoch"))
    files = trace.select("event_id", "file_name")
    return epochs.assign_epoch(files, starts, initial=dt.datetime(1999, 12, 31))


@query(
    "epoch_before_first_restart",
    tv.TRACE_SQL
    + """
, tail AS (
  SELECT * FROM trace WHERE epoch > (SELECT min(epoch) FROM trace) OR event_sequence > 100
)
SELECT event_id, file_name, event_sequence,
       CASE WHEN epoch = (SELECT min(epoch) FROM trace) THEN TIMESTAMP '2000-01-01 00:00:00'
            ELSE (SELECT min(event_time) FROM trace t WHERE t.epoch = tail.epoch) END AS epoch
FROM tail
""",
)
def epoch_before_first_restart(spark, sf_dir):
    # The trace is exported from the middle of its first run: the restart of that run is not in it.
    trace = tv.trace(spark, sf_dir).withColumn("event_time", F.col("event_time").cast("timestamp"))
    first = trace.agg(F.min("epoch")).scalar()
    tail = trace.where((F.col("epoch") > first) | (F.col("event_sequence") > 100))
    dated = epochs.assign_epoch(tail.select("event_id", "file_name", "event_sequence", "event_time"))
    return dated.drop("event_time").withColumn("epoch", display_time("epoch", "UTC"))


@query(
    "prune_connections",
    tv.TRACE_SQL
    + """
SELECT * FROM logins QUALIFY row_number() OVER (PARTITION BY session_id, epoch ORDER BY event_sequence DESC) = 1
""",
)
def prune_connections(spark, sf_dir):
    return lifecycle.prune_connections(tv.logins(tv.trace(spark, sf_dir)))


@query(
    "retention_purge",
    tv.TRACE_SQL
    + """
SELECT event_id, event_time FROM statements
WHERE event_time >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY
""",
)
def retention_purge(spark, sf_dir):
    statements = tv.statements(tv.trace_rows(spark, sf_dir)).select("event_id", "event_time")
    now = tv.events(spark, sf_dir).agg(F.max("ts")).scalar()
    return lifecycle.retain(statements, "event_time", now, days=10)


@query(
    "retention_bounded_pass",
    tv.TRACE_SQL
    + """
, expired AS (
  SELECT event_id FROM statements WHERE event_time < (SELECT max(ts) FROM events) - INTERVAL 10 DAY
  ORDER BY event_time, event_id LIMIT 1000
)
SELECT event_id, event_time FROM statements WHERE event_id NOT IN (SELECT event_id FROM expired)
""",
)
def retention_bounded_pass(spark, sf_dir):
    # One bounded delete pass: the 1000 oldest expired rows go, the rest waits for the next pass.
    statements = tv.statements(tv.trace_rows(spark, sf_dir)).select("event_id", "event_time")
    now = tv.events(spark, sf_dir).agg(F.max("ts")).scalar()
    return lifecycle.retain(statements, "event_time", now, days=10, max_rows=1000, order=["event_id"])


@query(
    "epoch_retention",
    tv.TRACE_SQL
    + """
, ranked AS (
  SELECT epoch, count(*) AS logins, dense_rank() OVER (ORDER BY epoch DESC) AS session_history_rank
  FROM logins GROUP BY epoch
)
SELECT epoch, logins, session_history_rank,
       session_history_rank = 1 OR epoch >= (SELECT max(ts) FROM events) - INTERVAL 15 DAY AS kept
FROM ranked
""",
)
def epoch_retention(spark, sf_dir):
    now = tv.events(spark, sf_dir).agg(F.max("ts")).scalar()
    return lifecycle.epoch_retention_report(tv.logins(tv.trace_rows(spark, sf_dir)), now, days=15)


@query(
    "connection_retention",
    tv.TRACE_SQL
    + """
, now AS (SELECT max(ts) AS at FROM events)
SELECT l.* FROM logins l, now
WHERE (epoch >= now.at - INTERVAL 15 DAY OR epoch = (SELECT max(epoch) FROM logins))
  AND event_time >= now.at - INTERVAL 15 DAY
""",
)
def connection_retention(spark, sf_dir):
    now = tv.events(spark, sf_dir).agg(F.max("ts")).scalar()
    return lifecycle.retain_connections(tv.logins(tv.trace(spark, sf_dir)), now, days=15, at="event_time")


_LISTING_SQL = """
, listing AS (SELECT DISTINCT file_name AS path FROM trace WHERE event_time >= TIMESTAMP '2024-01-11 00:00:00')
"""


def _listing(trace):
    recent = trace.where("event_time >= TIMESTAMP_NTZ '2024-01-11 00:00:00'")
    return recent.select(F.col("file_name").alias("path")).distinct()


@query(
    "lost_files",
    _CHECKPOINT_SQL
    + _LISTING_SQL
    + """
SELECT file_name, 'Lost audit file: ' || file_name AS msg
FROM (SELECT file_name FROM checkpoints EXCEPT SELECT path FROM listing)
""",
)
def lost_files(spark, sf_dir):
    trace = tv.trace_rows(spark, sf_dir)
    return lifecycle.lost_files(_checkpoints(trace), _listing(trace), latest_only=False)


@query(
    "disposable_files",
    tv.TRACE_SQL + _LISTING_SQL + "SELECT min(path) AS path, count(*) AS nb_files FROM listing HAVING count(*) > 1",
)
def disposable_files(spark, sf_dir):
    return lifecycle.disposable_files(_listing(tv.trace_rows(spark, sf_dir)))


@query(
    "finished_files",
    _CHECKPOINT_SQL + _LISTING_SQL + "SELECT path FROM listing WHERE path < (SELECT file_name FROM cp)",
)
def finished_files(spark, sf_dir):
    trace = tv.trace_rows(spark, sf_dir)
    return lifecycle.finished_files(_listing(trace), _checkpoints(trace))


@query(
    "epoch_freshness",
    tv.TRACE_SQL
    + """
SELECT epoch, min(event_time) AS first_event, max(event_time) AS last_event, count(*) AS events,
       epoch = (SELECT max(epoch) FROM trace)
         AND max(event_time) < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 15 MINUTE AS silent
FROM trace GROUP BY epoch
""",
)
def epoch_freshness(spark, sf_dir):
    return lifecycle.freshness(tv.trace_rows(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


@query(
    "legacy_migration",
    tv.TRACE_SQL
    + """
SELECT 'user_' || CAST(session_id AS VARCHAR) AS login_name, CAST(session_id AS INTEGER) AS session_id,
       event_time AS login_time, client_net_address, client_app_name,
       TIMESTAMP '2000-01-01 00:00:00' AS epoch, event_sequence
FROM logins
""",
)
def legacy_migration(spark, sf_dir):
    from tracewell.operators.migrate import migrate_legacy

    old = tv.logins(tv.trace(spark, sf_dir)).select(
        F.concat(F.lit("user_"), F.col("session_id")).alias("LoginName"),
        F.col("session_id").alias("Session_id"),
        F.col("event_time").alias("LoginTime"),
        F.col("client_net_address").alias("Client_net_address"),
        "client_app_name",
        "event_sequence",
    )
    return migrate_legacy(old, "HistoriqueConnexions").withColumn("epoch", display_time("epoch", "UTC"))


@query(
    "distinct_logins",
    tv.TRACE_SQL + "SELECT DISTINCT session_id, client_net_address, client_app_name FROM logins",
)
def distinct_logins(spark, sf_dir):
    logins = tv.logins(tv.trace_rows(spark, sf_dir))
    return logins.select("session_id", "client_net_address", "client_app_name").distinct()


@query(
    "raw_capture",
    tv.TRACE_SQL + "SELECT file_name, file_offset, CAST(0 AS INTEGER) AS batch_id, count(*) AS events FROM trace GROUP BY ALL",
)
def raw_capture(spark, sf_dir):
    # The debug copy of raw events under its import number, read back.

    path = new_work_path(spark, "bronze")
    tables.capture_raw(tv.raw_trace(tv.trace(spark, sf_dir)), path, 0)
    kept = spark.read.parquet(path)
    return kept.groupBy("file_name", "file_offset", "batch_id").agg(F.count(F.lit(1)).alias("events"))




@query(
    "audit_packed_browse",
    f"SELECT * FROM ({_AUDIT_SQL}) WHERE server_principal_name IN ('user_51', 'user_77', 'user_90')",
)
def audit_packed_browse(spark, sf_dir):
    # The audit in two generations a date, packed by user, then looked up by user: only files and row groups of theirs are read.
    from tracewell.model import FULL_AUDIT
    from tracewell.streaming.audit_stream import AuditStore

    batch = audit_batch(tv.raw_trace(tv.trace(spark, sf_dir)), tv.live_sessions(spark, sf_dir))
    dated = batch.audit.select("file_name", *FULL_AUDIT.names, "source", utc_date("event_time").alias("event_date"))
    dated = materialise(dated, "dated")
    store = AuditStore(spark, new_work_path(spark, "store"))
    for half in (0, 1):
        store.parts().append(dated.where(F.pmod("event_sequence", F.lit(2)) == half), f"half-{half}")
    store.compact(dt.date(2100, 1, 1))
    store.vacuum()
    return _compact_audit(store.audit().where(F.col("server_principal_name").isin("user_51", "user_77", "user_90")))


@query(
    "stored_logins",
    tv.TRACE_SQL
    + """
, started AS (SELECT epoch AS week, min(event_time) AS epoch FROM trace GROUP BY ALL)
SELECT 'user_' || CAST(session_id AS VARCHAR) AS login_name, CAST(session_id AS INTEGER) AS session_id, event_time AS login_time,
       client_net_address, client_app_name, w.epoch, event_sequence
FROM logins l JOIN started w ON l.epoch = w.week
""",
)
def stored_logins(spark, sf_dir):
    # All logins that a stream has met, each once, though their file came twice.
    from tracewell.streaming.audit_stream import AuditStore, audit_stream

    incoming, store = new_work_path(spark, "incoming"), AuditStore(spark, new_work_path(spark, "store"))
    raw = materialise(tv.raw_trace(tv.trace(spark, sf_dir)), "raw")
    raw.unionByName(raw.where("file_name < 'T_0_20240105'")).write.parquet(incoming)
    audit_stream(spark, incoming, store).awaitTermination()
    return store.logins().withColumn("epoch", display_time("epoch", "UTC"))


@query("list_trace_files", tv.TRACE_SQL + "SELECT DISTINCT file_name FROM trace WHERE file_name >= 'T_0_20240110'")
def list_trace_files(spark, sf_dir):
    # Files written as the capture side does, listed by name; one folder further down is not.
    folder = new_work_path(spark, "listing")
    raw = materialise(tv.raw_trace(tv.trace(spark, sf_dir)), "raw")
    tv.write_trace_files(raw.where("file_name >= 'T_0_20240110'"), folder, 1.0)
    tv.write_trace_files(raw.where("file_name < 'T_0_20240110'"), f"{folder}/older", 1.0)
    listed = source.list_trace_files(spark, folder)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


@query(
    "existing_files",
    _CHECKPOINT_SQL
    + _LISTING_SQL
    + """
SELECT c.file_name AS path, CASE WHEN l.path IS NOT NULL THEN 1 END AS existing
FROM checkpoints c LEFT JOIN listing l ON l.path = c.file_name
""",
)
def existing_files(spark, sf_dir):
    from tracewell.functions.text import existing_files as marked

    trace = tv.trace_rows(spark, sf_dir)
    return marked(_checkpoints(trace).select(F.col("file_name").alias("path")), _listing(trace))


@query(
    "process_log",
    tv.TRACE_SQL + "SELECT 'Lost audit file: ' || file_name AS msg, count(*) AS n FROM trace GROUP BY file_name",
)
def process_log(spark, sf_dir):
    # Every file is named lost once for each event in it, in three writes; the log holds all messages.
    path = new_work_path(spark, "log")
    names = materialise(tv.trace_rows(spark, sf_dir).select("event_id", F.concat(F.lit("Lost audit file: "), "file_name").alias("msg")), "names")
    for part in range(3):
        tables.log_messages(names.where(F.col("event_id") % 3 == part), path)
    return spark.read.parquet(path).groupBy("msg").agg(F.count("*").alias("n"))


@query(
    "legacy_checkpoint",
    tv.TRACE_SQL
    + """
SELECT file_name, max(file_offset) AS last_offset_done, max(event_time) AS chk_point_time, TIMESTAMP '2000-01-01 00:00:00' AS epoch
FROM trace GROUP BY file_name
""",
)
def legacy_checkpoint(spark, sf_dir):
    from tracewell.operators.migrate import migrate_legacy

    old = tv.trace_rows(spark, sf_dir).groupBy("file_name").agg(
        F.max("file_offset").alias("last_Offset_done"), F.max("event_time").alias("DateSuivi"), F.count("*").alias("NbTotalFich")
    )
    new = migrate_legacy(old, "EvenementsTraitesSuivi")
    return new.withColumns({c: display_time(c, "UTC") for c in ("chk_point_time", "epoch")})


@query(
    "legacy_audit",
    tv.TRACE_SQL
    + """
SELECT 'user_' || CAST(session_id AS VARCHAR) AS server_principal_name, event_time, CAST(session_id AS INTEGER) AS session_id,
       epoch, event_sequence, k * 2 AS cpu_time, CAST(NULL AS BIGINT) AS dur_micro_sec
FROM statements
""",
)
def legacy_audit(spark, sf_dir):
    from tracewell.operators.migrate import migrate_legacy_audit

    # An audit of before its counters: one is there, the others are added as NULL.
    old = tv.statements(tv.trace(spark, sf_dir)).select(
        F.concat(F.lit("user_"), F.col("session_id")).alias("server_principal_name"), "event_time", F.col("session_id").alias("Session_id"),
        F.col("epoch").alias("ExtendedSessionCreateTime"), "event_sequence", (F.col("k") * 2).alias("cpu_time"),
    )
    new = migrate_legacy_audit(old).withColumns({c: display_time(c, "UTC") for c in ("event_time", "epoch")})
    return new.select("server_principal_name", "event_time", "session_id", "epoch", "event_sequence", "cpu_time", "dur_micro_sec")


@query(
    "legacy_log",
    tv.TRACE_SQL + "SELECT event_time AS msg_date, 'event ' || event_id AS msg FROM trace WHERE event_type = 'error'",
)
def legacy_log(spark, sf_dir):
    from tracewell.operators.migrate import migrate_legacy

    errors = tv.trace_rows(spark, sf_dir).where("event_type = 'error'")
    old = errors.select(F.col("event_time").alias("MsgDate"), F.concat(F.lit("event "), F.col("event_id")).alias("Msg"))
    return migrate_legacy(old, "LogTraitementAudit").withColumn("msg_date", display_time("msg_date", "UTC"))
