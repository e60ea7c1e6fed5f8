"""Queries on logins, statements, jobs, load and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.times import utc_date
from tracewell.operators import analytics, monitoring, reports
from tracewell.plans.gates import all_match, keep_if
from tracewell.plans.intervals import interval_join
from tracewell.plans.patterns import pattern_join
from tracewell.session import materialise
from tracewell.workload import trace_view as tv
from tracewell.workload.registry import query, table


@query(
    "host_most_used",
    tv.TRACE_SQL
    + """
, recent AS (
  SELECT session_id, client_net_address, event_time FROM logins
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_time DESC) <= 10
), uses AS (
  SELECT session_id, client_net_address, count(*) AS uses, max(event_time) AS last_use FROM recent GROUP BY ALL
)
SELECT 'user_' || CAST(session_id AS VARCHAR) AS login_name, client_net_address, uses FROM uses
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY uses DESC, last_use DESC) = 1
""",
)
def host_most_used(spark, sf_dir):
    logins = tv.logins(tv.trace_rows(spark, sf_dir)).select(
        F.concat(F.lit("user_"), F.col("session_id")).alias("login_name"),
        "client_net_address",
        F.col("event_time").alias("login_time"),
        "event_id",
    )
    return analytics.host_most_used(logins, tie="event_id")


@query(
    "sequence_gaps",
    tv.TRACE_SQL
    + """
, steps AS (
  SELECT event_id, session_id, k, lag(k, 1, 0) OVER (PARTITION BY session_id ORDER BY k, event_id) AS bs FROM trace
)
SELECT * FROM steps WHERE k - bs <> 1
""",
)
def sequence_gaps(spark, sf_dir):
    numbered = tv.trace_rows(spark, sf_dir).select("event_id", "session_id", "k")
    return analytics.find_missing_seq(numbered, "session_id", "k", tie="event_id")


@query(
    "numbered_statement_gaps",
    tv.TRACE_SQL
    + """
, numbered AS (
  SELECT event_id, CAST(session_id % 1000 AS INTEGER) AS f,
         row_number() OVER (PARTITION BY epoch ORDER BY event_sequence) AS rn, event_sequence AS s
  FROM statements
), steps AS (
  SELECT event_id, f, s, lag(s, 1, 0) OVER (PARTITION BY f ORDER BY s, event_id) AS bs FROM numbered
)
SELECT event_id, f, s, bs FROM steps WHERE s - bs <> 1
""",
)
def numbered_statement_gaps(spark, sf_dir):
    # Texts as the load test sends them, every other kind with the leading comment.
    # Padded, but never cut: lpad would shorten a number of six digits.
    f, s = F.format_string("%03d", F.col("session_id") % 1000), F.format_string("%05d", "event_sequence")
    body = F.concat(F.lit("SELECT Fen="), f, F.lit(",Seq="), s, F.lit(",title FROM Posts"))
    tagged = F.concat(F.lit("/*"), f, F.lit("-"), s, F.lit("*/"), body)
    statements = tv.statements(tv.trace(spark, sf_dir)).select(
        "event_id", F.when(F.col("event_type") == "click", tagged).otherwise(body).alias("statement")
    )
    numbered = analytics.numbered_statements(statements).drop("statement")
    return analytics.find_missing_seq(numbered, "f", "s", tie="event_id")


@query(
    "statement_sequence_gaps",
    tv.TRACE_SQL
    + """
, steps AS (
  SELECT event_id, epoch, event_sequence, lag(event_sequence, 1, 0) OVER (PARTITION BY epoch ORDER BY event_sequence) AS bs
  FROM statements
)
SELECT * FROM steps WHERE event_sequence - bs <> 1
""",
)
def statement_sequence_gaps(spark, sf_dir):
    statements = tv.statements(tv.trace(spark, sf_dir)).select("event_id", "epoch", "event_sequence")
    return analytics.sequence_holes(statements)


_JOB_SQL = (
    tv.TRACE_SQL
    + """
, history AS (
  SELECT session_id AS job_id, event_id AS instance_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS step_id,
         CAST(k % 7 AS INTEGER) AS run_status, event_type AS message
  FROM trace
), limits AS (
  SELECT job_id, instance_id AS job_end, lag(instance_id, 1, 0) OVER (PARTITION BY job_id ORDER BY instance_id) AS previous_end
  FROM history WHERE step_id = 0
), last_run AS (
  SELECT * FROM limits QUALIFY dense_rank() OVER (PARTITION BY job_id ORDER BY job_end DESC) = 1
), steps AS (
  SELECT h.job_id, h.instance_id, h.step_id, h.run_status, h.message,
         CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled'
                         WHEN 4 THEN 'In Progress' END AS status
  FROM history h JOIN last_run r ON h.job_id = r.job_id AND h.instance_id <= r.job_end AND h.instance_id > r.previous_end
)
"""
)


def _history(spark, sf_dir):
    return tv.trace_rows(spark, sf_dir).select(
        F.col("session_id").alias("job_id"),
        F.col("event_id").alias("instance_id"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("step_id"),
        (F.col("k") % 7).cast("int").alias("run_status"),
        F.col("event_type").alias("message"),
    )


@query("last_job_run", _JOB_SQL + "SELECT * FROM steps")
def last_job_run(spark, sf_dir):
    return analytics.last_job_run(_history(spark, sf_dir))


@query(
    "job_needs_attention",
    _JOB_SQL + "SELECT * FROM steps WHERE status IS NULL OR status <> 'Succeeded'",
)
def job_needs_attention(spark, sf_dir):
    return analytics.job_needs_attention(_history(spark, sf_dir))


@query(
    "union_header",
    _JOB_SQL
    + """
SELECT job_id, CAST(0 AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS status,
       'Status from previous ' || CAST(job_id AS VARCHAR) || ' job execution ' AS msgs FROM last_run
UNION ALL
SELECT job_id, instance_id, status, message || chr(13) || chr(10) FROM steps
""",
)
def union_header(spark, sf_dir):
    return analytics.job_status_report(_history(spark, sf_dir))


@query(
    "daily_weekday_counts",
    tv.TRACE_SQL
    + """
SELECT CAST(event_time AS DATE) AS event_date, dayname(event_time) AS week_day, count(*) AS nb_qry
FROM statements GROUP BY ALL
""",
)
def daily_weekday_counts(spark, sf_dir):
    return analytics.daily_weekday_counts(tv.statements(tv.trace_rows(spark, sf_dir)))


@query(
    "audit_browse",
    tv.TRACE_SQL
    + """
SELECT event_id, event_time, 'user_' || CAST(s.session_id AS VARCHAR) AS server_principal_name,
       coalesce(l.client_net_address, '(Cur)-> ' || c.client_net_address, 'session is gone') AS client_net_address
FROM (SELECT s.*, l.client_net_address AS a FROM statements s ASOF LEFT JOIN logins l
        ON s.session_id = l.session_id AND s.event_id > l.event_id) s
  LEFT JOIN (SELECT NULL AS client_net_address) l ON true
  LEFT JOIN live c ON c.session_id = s.session_id
WHERE s.a IS NULL AND c.client_net_address IS NOT NULL
  AND event_time >= TIMESTAMP '2024-01-03 00:00:00' AND event_time < TIMESTAMP '2024-01-20 00:00:00'
""",
)
def audit_browse(spark, sf_dir):
    from tracewell.operators.attribution import attribute_with_fallback

    trace = tv.trace(spark, sf_dir)
    statements = tv.statements(trace).select(
        "event_id",
        "event_time",
        "session_id",
        "epoch",
        "event_sequence",
        F.concat(F.lit("user_"), F.col("session_id")).alias("server_principal_name"),
    )
    audit = attribute_with_fallback(statements, tv.logins(trace), tv.live_sessions(spark, sf_dir))
    # Browsing is for the stored table: its date partitions are pruned before anything is read.
    audit = materialise(audit.withColumn("event_date", utc_date("event_time")), "browse", partition_by="event_date")
    found = analytics.browse_audit(
        audit,
        since=F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"),
        until=F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"),
        from_live_view=True,
    )
    return found.select("event_id", "event_time", "server_principal_name", "client_net_address")


@query(
    "event_trace_map",
    """
SELECT DISTINCT l.l_suppkey AS trace_event_id, s.s_name AS event_class, n.n_name AS package,
       CAST(m.s_nationkey AS VARCHAR) AS x_event_name, l.l_partkey AS trace_column_id,
       p.p_name AS sql_trace_column, a.p_type AS extended_events_action
FROM supplier s
  LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) m ON s.s_suppkey = m.s_suppkey
  LEFT JOIN nation n ON n.n_nationkey = m.s_nationkey
  LEFT JOIN lineitem l ON l.l_suppkey = m.s_suppkey
  LEFT JOIN part p ON p.p_partkey = l.l_partkey
  LEFT JOIN (SELECT * FROM part WHERE p_size < 25) a ON a.p_partkey = p.p_partkey
""",
)
def event_trace_map(spark, sf_dir):
    # Suppliers as event classes, line items as bindings, parts as trace columns and (small ones) as actions.
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    classes = supplier.select(F.col("s_suppkey").alias("trace_event_id"), F.col("s_name").alias("name"))
    mapped = (
        supplier.where("s_acctbal > 0")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("trace_event_id"),
            F.col("n_name").alias("package_name"),
            F.col("s_nationkey").cast("string").alias("xe_event_name"),
        )
    )
    bindings = lineitem.select(F.col("l_suppkey").alias("trace_event_id"), F.col("l_partkey").alias("trace_column_id"))
    columns = part.select(F.col("p_partkey").alias("trace_column_id"), F.col("p_name").alias("name"))
    actions = part.where("p_size < 25").select(
        F.col("p_partkey").alias("trace_column_id"), F.col("p_type").alias("xe_action_name")
    )
    return analytics.event_trace_map(classes, mapped, bindings, columns, actions)


# Fixed value: the pattern table of the query below.
_TYPE_PATTERNS = [("%BRASS", "metal"), ("%steel", "metal"), ("PROMO%", "promotion"), ("%plated%", "plated")]


@query(
    "pattern_lookup",
    """
SELECT p_partkey, p_type, pattern, label FROM part
JOIN (VALUES ('%BRASS', 'metal'), ('%steel', 'metal'), ('PROMO%', 'promotion'), ('%plated%', 'plated')) t(pattern, label)
  ON p_type ILIKE pattern
""",
)
def pattern_lookup(spark, sf_dir):
    return text.match_patterns(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", _TYPE_PATTERNS)


@query(
    "pattern_table_join",
    tv.TRACE_SQL
    + f"""
, watched AS (SELECT '%BY ' || CAST(c_custkey AS VARCHAR) || ' *_' AS pattern, c_name FROM customer WHERE c_acctbal > 0)
SELECT event_id, c_name, pattern FROM (SELECT *, {tv.STATEMENT_SQL} AS statement FROM statements) JOIN watched ON statement ILIKE pattern
""",
)
def pattern_table_join(spark, sf_dir):
    # A pattern for each watched customer, as a table: which statements carry their mark.
    statements = tv.statements(tv.trace_rows(spark, sf_dir)).select("event_id", tv.statement_text().alias("statement"))
    watched = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    watched = watched.select(F.concat(F.lit("%BY "), F.col("c_custkey").cast("string"), F.lit(" *_")).alias("pattern"), "c_name")
    return pattern_join(statements, "statement", watched, "pattern").select("event_id", "c_name", "pattern")


@query(
    "interval_runs",
    tv.TRACE_SQL
    + """
, runs AS (
  SELECT session_id, event_id AS run_end, lag(event_id) OVER (PARTITION BY session_id ORDER BY event_id) AS previous_end
  FROM trace WHERE event_type = 'error'
)
SELECT t.event_id, t.session_id, t.event_type, r.run_end
FROM trace t JOIN runs r ON t.session_id = r.session_id AND t.event_id <= r.run_end
  AND (r.previous_end IS NULL OR t.event_id > r.previous_end)
""",
)
def interval_runs(spark, sf_dir):
    # An error ends a run of its user; every step lies in (previous end, end]. The first run has no previous end.
    trace = tv.trace_rows(spark, sf_dir)
    ends = trace.where("event_type = 'error'").select("session_id", F.col("event_id").alias("run_end"))
    before = F.lag("run_end").over(Window.partitionBy("session_id").orderBy("run_end"))
    steps = trace.select("event_id", "session_id", "event_type")
    met = interval_join(steps, ends.withColumn("previous_end", before), "event_id", "previous_end", "run_end", by=["session_id"])
    return met.select("event_id", "session_id", "event_type", "run_end")


@query(
    "sessions_open_by_hour",
    tv.TRACE_SQL
    + """
, hours AS (SELECT DISTINCT CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS hour FROM trace)
, held AS (
  SELECT session_id, event_time AS since, lead(event_time) OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS until FROM logins
)
SELECT hour, count(*) AS logins FROM hours JOIN held ON since <= hour AND (until IS NULL OR hour < until) GROUP BY hour
""",
)
def sessions_open_by_hour(spark, sf_dir):
    # A login holds until the next one of its session; the last ones are open. No key: only the interval joins.
    trace = tv.trace_rows(spark, sf_dir)
    hours = trace.select(F.date_trunc("hour", "event_time").cast("timestamp_ntz").alias("hour")).distinct()
    after = F.lead("since").over(Window.partitionBy("session_id").orderBy("since", "event_id"))
    held = trace.where("is_login").select("session_id", F.col("event_time").alias("since"), "event_id").withColumn("until", after)
    met = interval_join(hours, held.drop("event_id"), "hour", "since", "until", closed="left")
    return met.groupBy("hour").agg(F.count("*").alias("logins"))


@query(
    "threshold_left_join_gate",
    """
SELECT 'all priced' AS gate, count(*) = count(CASE WHEN p_retailprice > 0 THEN 1 END) AS open FROM part
UNION ALL
SELECT 'all big', count(*) = count(CASE WHEN p_size > 25 THEN 1 END) FROM part
UNION ALL
SELECT 'none at all', count(*) = count(CASE WHEN p_size > 25 THEN 1 END) FROM part WHERE p_size < 0
""",
)
def threshold_left_join_gate(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    gates = [
        ("all priced", all_match(part, F.col("p_retailprice") > 0)),
        ("all big", all_match(part, F.col("p_size") > 25)),
        ("none at all", all_match(part.where("p_size < 0"), F.col("p_size") > 25)),
    ]
    rows = [gate.select(F.lit(name).alias("gate"), "open") for name, gate in gates]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _statement_costs(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("statement_id"))
        .agg(
            F.count(F.lit(1)).alias("execution_count"),
            F.sum(cents).alias("total_worker_time"),
            F.sum(F.col("l_quantity").cast("long")).alias("total_logical_reads"),
        )
    )


_COSTS_SQL = """
WITH costs AS (
  SELECT l_partkey AS statement_id, count(*) AS execution_count,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_worker_time,
         CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS total_logical_reads
  FROM lineitem GROUP BY l_partkey
), samples AS (
  SELECT event_id AS record_id, value AS sql_cpu_utilization FROM events ORDER BY event_id DESC LIMIT 4
)
"""


@query(
    "top_cost_statements",
    _COSTS_SQL
    + """
SELECT *, total_worker_time // execution_count AS avg_cpu_time FROM costs
WHERE (SELECT count(*) = count(CASE WHEN sql_cpu_utilization > 0 THEN 1 END) FROM samples)
ORDER BY total_worker_time DESC, statement_id LIMIT 25
""",
)
def top_cost_statements(spark, sf_dir):
    samples = tv.events(spark, sf_dir).select(
        F.col("event_id").alias("record_id"), F.col("value").alias("sql_cpu_utilization")
    )
    return monitoring.top_statements_when_hot(
        samples, _statement_costs(spark, sf_dir), threshold=0, tie=["statement_id"]
    )


@query(
    "top_cost_statements_idle",
    _COSTS_SQL
    + """
SELECT *, total_worker_time // execution_count AS avg_cpu_time FROM costs
WHERE (SELECT count(*) = count(CASE WHEN sql_cpu_utilization > 1000000 THEN 1 END) FROM samples)
ORDER BY total_worker_time DESC, statement_id LIMIT 25
""",
)
def top_cost_statements_idle(spark, sf_dir):
    samples = tv.events(spark, sf_dir).select(
        F.col("event_id").alias("record_id"), F.col("value").alias("sql_cpu_utilization")
    )
    return monitoring.top_statements_when_hot(
        samples, _statement_costs(spark, sf_dir), threshold=1_000_000, tie=["statement_id"]
    )


@query(
    "zero_row_gate",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE (SELECT count(*) > 0 FROM part WHERE p_size > 45)",
)
def zero_row_gate(spark, sf_dir):
    big = table(spark, sf_dir, "part").where("p_size > 45").agg((F.count(F.lit(1)) > 0).alias("open"))
    return keep_if(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), big)


@query(
    "statement_in_batch",
    """
WITH d AS (SELECT doc_id, text, doc_id % 11 AS a, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 11 + doc_id % 40 END AS b FROM documents)
SELECT doc_id, substr(text, CAST(a AS INTEGER) + 1, CAST(CASE WHEN b = -1 THEN length(text) ELSE b END - a AS INTEGER)) AS statement FROM d
""",
)
def statement_in_batch(spark, sf_dir):
    # Offsets count bytes of UTF-16 from 0, as the server counts; -1 is the end of the batch.
    first, last = F.col("doc_id") % 11, F.col("doc_id") % 11 + F.col("doc_id") % 40
    batches = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (2 * first).alias("a"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(2 * last).alias("b")
    )
    return batches.select("doc_id", monitoring.statement_text("text", "a", "b").alias("statement"))


@query(
    "snapshot_delta",
    """
WITH s AS (
  SELECT o_custkey AS database_id, o_orderstatus AS file_id, o_orderdate AS ordered,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
), b AS (
  SELECT database_id, file_id, count(*) AS num_of_reads, CAST(sum(cents) AS BIGINT) AS io_stall
  FROM s WHERE ordered < TIMESTAMP '1997-01-01' GROUP BY ALL
), c AS (
  SELECT database_id, file_id, count(*) AS num_of_reads, CAST(sum(cents) AS BIGINT) AS io_stall
  FROM s GROUP BY ALL
)
SELECT c.database_id, c.file_id, c.num_of_reads - b.num_of_reads AS num_of_reads_in_interval,
       c.io_stall - b.io_stall AS io_stall_in_interval
FROM c JOIN b USING (database_id, file_id)
""",
)
def snapshot_delta(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("database_id"),
        F.col("o_orderstatus").alias("file_id"),
        F.col("o_orderdate").alias("at"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )

    def totals(seen):
        return seen.groupBy("database_id", "file_id").agg(
            F.count(F.lit(1)).alias("num_of_reads"), F.sum("cents").alias("io_stall")
        )

    # The counters at the start of 1997 and at the end.
    first = orders.where(F.col("at") < F.expr("TIMESTAMP_NTZ '1997-01-01'"))
    return monitoring.snapshot_delta(totals(first), totals(orders), ["database_id", "file_id"], ["num_of_reads", "io_stall"])


@query(
    "offset_profile",
    tv.TRACE_SQL
    + """
, counts AS (SELECT file_name, file_offset, count(*) AS n FROM trace GROUP BY ALL)
, ranked AS (
  SELECT *, row_number() OVER w AS rn, lag(file_offset) OVER w AS last_offset, lag(n) OVER w AS last_count
  FROM counts WINDOW w AS (PARTITION BY file_name ORDER BY file_offset DESC)
)
SELECT file_name, file_offset, n, last_offset, last_count FROM ranked WHERE rn = 2
""",
)
def offset_profile(spark, sf_dir):
    return monitoring.offset_profile(tv.trace_rows(spark, sf_dir).select("file_name", "file_offset"))


@query(
    "offset_regressions",
    tv.TRACE_SQL
    + """
, before AS (
  SELECT file_name, file_offset, count(*) AS n FROM trace
  WHERE event_time < TIMESTAMP '2024-01-16 12:30:00' GROUP BY ALL
), again AS (SELECT file_name, file_offset, count(*) AS n_after FROM trace GROUP BY ALL)
SELECT file_name, file_offset, n, coalesce(n_after, 0) AS n_after
FROM before LEFT JOIN again USING (file_name, file_offset) WHERE coalesce(n_after, 0) <> n
""",
)
def offset_regressions(spark, sf_dir):
    # A reading cut in the middle of an offset shows up as the one offset that grew.
    trace = tv.trace_rows(spark, sf_dir).select("file_name", "file_offset", "event_time")
    return monitoring.offset_regressions(trace.where("event_time < TIMESTAMP_NTZ '2024-01-16 12:30:00'"), trace)


@query(
    "path_parts",
    r"""
SELECT page_id, url, regexp_extract(url, '^(.*/)[^/]*$', 1, 's') AS directory,
       regexp_extract(url, '^.*/([^/]*)$', 1, 's') AS file_name
FROM pages
""",
)
def path_parts(spark, sf_dir):
    return text.file_path_parts(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "/")


@query(
    "error_messages",
    tv.TRACE_SQL
    + """
SELECT event_id,
  ' Msg: ' || event_type || ' of ' || CAST(session_id AS VARCHAR) || ' Error: ' || CAST(k + 50000 AS VARCHAR)
  || ' Severity: ' || CAST(k % 25 AS VARCHAR) || ' State: 1'
  || coalesce(' at Line:' || CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) END, '')
  || coalesce(' in Sql Module:' || CASE WHEN k % 5 <> 0 THEN 'proc_' || CAST(k % 5 AS VARCHAR) END, '') AS err_msg
FROM trace WHERE event_type = 'error'
""",
)
def error_messages(spark, sf_dir):
    errors = (
        tv.trace_rows(spark, sf_dir)
        .where("event_type = 'error'")
        .select(
            "event_id",
            (F.col("k") + 50000).alias("number"),
            (F.col("k") % 25).alias("severity"),
            F.lit(1).alias("state"),
            F.when(F.col("k") % 3 != 0, F.col("k")).alias("line"),
            F.when(F.col("k") % 5 != 0, F.concat(F.lit("proc_"), F.col("k") % 5)).alias("procedure"),
            F.concat("event_type", F.lit(" of "), F.col("session_id")).alias("message"),
        )
    )
    return text.format_error_messages(errors, text.ERROR_TEMPLATE_SHORT).select("event_id", "err_msg")


@query(
    "template_fill",
    """
SELECT p_partkey, 'Version ''' || p_brand || ''' of ' || p_name || ' installed: ' || p_brand AS msg FROM part
""",
)
def template_fill(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    filled = text.fill_template(
        F.lit('Version "#version#" of #Name# installed: #Version#'), "#version#", F.col("p_brand")
    )
    return part.select("p_partkey", text.fill_template(filled, "#name#", F.col("p_name")).alias("msg"))


@query(
    "alert_digest",
    tv.TRACE_SQL
    + """
, last3 AS (SELECT event_id, value FROM trace WHERE event_type = 'error' ORDER BY event_time DESC, event_id DESC LIMIT 3)
SELECT string_agg('error ' || CAST(event_id AS VARCHAR), '<br>' ORDER BY event_id DESC) AS digest FROM last3
""",
)
def alert_digest(spark, sf_dir):
    log = (
        tv.trace_rows(spark, sf_dir)
        .where("event_type = 'error'")
        .select("event_id", F.col("event_time").alias("msg_date"), F.concat(F.lit("error "), "event_id").alias("msg"))
    )
    return reports.alert_digest(log, tie="event_id")


# Fixed value: the event types of the trace view.
_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "pivot_actions",
    """
SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click,
       max(value) FILTER (WHERE event_type = 'error') AS error,
       max(value) FILTER (WHERE event_type = 'purchase') AS purchase,
       max(value) FILTER (WHERE event_type = 'signup') AS signup,
       max(value) FILTER (WHERE event_type = 'view') AS "view"
FROM events GROUP BY user_id
""",
)
def pivot_actions(spark, sf_dir):
    return analytics.pivot_actions(tv.events(spark, sf_dir), ["user_id"], "event_type", "value", _TYPES)


@query(
    "unpivot_actions",
    """
SELECT user_id, event_type AS action, max(value) AS value
FROM (SELECT DISTINCT user_id FROM events)
  CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)
  LEFT JOIN events USING (user_id, event_type)
GROUP BY ALL
""",
)
def unpivot_actions(spark, sf_dir):
    wide = analytics.pivot_actions(tv.events(spark, sf_dir), ["user_id"], "event_type", "value", _TYPES)
    return analytics.unpivot_actions(wide, ["user_id"], _TYPES, "action", "value")


@query(
    "json_array_outer",
    tv.TRACE_SQL
    + """
SELECT event_id, CASE WHEN k % 3 <> 0 THEN i END AS position, CASE WHEN k % 3 <> 0 THEN k + i END AS item
FROM trace, (VALUES (0), (1)) t(i) WHERE i = 0 OR k % 3 = 2
""",
)
def json_array_outer(spark, sf_dir):
    # The JSON text has no element, one or two, by k.
    both = F.when(F.col("k") % 3 == 2, F.concat(F.lit(',{"p":1,"v":'), F.col("k") + 1, F.lit("}"))).otherwise("")
    json = F.when(F.col("k") % 3 != 0, F.concat(F.lit('[{"p":0,"v":'), F.col("k"), F.lit("}"), both, F.lit("]")))
    rows = tv.trace_rows(spark, sf_dir).select("event_id", json.alias("json"))
    rows = rows.withColumn("items", F.from_json("json", "array<struct<p:int,v:bigint>>"))
    out = analytics.json_array_rows(rows, "items")
    return out.select("event_id", F.col("item.p").alias("position"), F.col("item.v").alias("item"))


@query(
    "statement_fingerprints",
    tv.TRACE_SQL
    + """
SELECT 'SELECT x FROM t WHERE kind = ''' || repeat(' ', length(event_type)) || ''' AND a < '
         || CAST(k % 5 AS VARCHAR) || ' /*' || repeat(' ', length(CAST(session_id AS VARCHAR)) + 5) || '*/' AS fingerprint,
       count(*) AS executions, CAST(sum(k * 2) AS BIGINT) AS cpu_time,
       CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS dur_micro_sec
FROM statements GROUP BY 1
""",
)
def statement_fingerprints(spark, sf_dir):
    audit = tv.statements(tv.trace_rows(spark, sf_dir)).select(
        tv.statement_text().alias("statement"),
        (F.col("k") * 2).alias("cpu_time"),
        (F.col("value") * 100).cast("long").alias("dur_micro_sec"),
    )
    return reports.statement_fingerprints(audit)


@query(
    "split_batches",
    r"""
WITH scripts AS (
  SELECT doc_id, string_split(text, '. ') AS p, chr(10) AS lf, chr(13) || chr(10) AS crlf, chr(39) AS q FROM documents
), chunks AS (
  SELECT *, unnest(generate_series(1, len(p))) AS c FROM scripts
)
SELECT doc_id, CAST(c - 1 AS INTEGER) AS chunk_no, least(c, len(p) - 1) % 2 = 1 AS errors_muted,
       CAST(b AS INTEGER) AS batch_no,
       CASE WHEN b = 1 THEN 'exec x'
            ELSE CASE WHEN c = 1 THEN '' WHEN c % 2 = 0 THEN crlf ELSE lf END
                 || 'SELECT ' || q || replace(p[c], q, q || q) || q || crlf || '/* a' || lf || 'GO' || lf || '/* b */' || crlf
                 || 'GO */ -- GO' END AS batch
FROM chunks, (SELECT unnest([0, 1]) AS b)
""",
)
def split_batches(spark, sf_dir):
    # Each sentence is a literal, followed by a nested comment and a batch of its own; switches alternate, as do breaks.
    sentence = F.transform(
        F.split("text", r"\. "),
        lambda x, i: F.concat(
            F.when(i == 0, "").when(i % 2 == 1, "\r\n--GO E-\r\n").otherwise("\n--GO E+\n"),
            F.lit("SELECT '"),
            F.replace(x, F.lit("'"), F.lit("''")),
            F.lit("'\r\n/* a\nGO\n/* b */\r\nGO */ -- GO\nGO\nexec x"),
        ),
    )
    documents = table(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism)
    scripts = documents.select("doc_id", F.array_join(sentence, "").alias("script"))
    return reports.split_batches(scripts, "doc_id")


@query(
    "sample_rows",
    """
WITH s AS (
  SELECT doc_id, lang FROM documents WHERE substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) < '80000000' AND lang IS NOT NULL
  ORDER BY doc_id LIMIT 3000
)
SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS seq FROM s
""",
)
def sample_rows(spark, sf_dir):
    return reports.sample_rows(table(spark, sf_dir, "documents"), "doc_id", 0.5, 3000, "lang")


@query(
    "run_status_labels",
    tv.TRACE_SQL
    + """
SELECT event_id, CASE k % 7 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled'
                            WHEN 4 THEN 'In Progress' END AS status
FROM trace
""",
)
def run_status_labels(spark, sf_dir):
    trace = tv.trace_rows(spark, sf_dir)
    return trace.select("event_id", analytics.run_status_label(F.col("k") % 7).alias("status"))
