"""The ``events`` table seen as a trace.

session = user; epoch = week, in which the event sequence restarts at 1; ``signup`` = login, other types =
statements; one file per day, one offset per hour. A login whose ``k`` ends in 0 carries no address. Live
sessions are the customers with money in their account.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import text_to_utf16_hex
from tracewell.workload.registry import table

#: Bytes gathered before they go to a trace file.
WRITE_BYTES = 1 << 20
ADDRESS = "CASE WHEN k % 10 <> 0 THEN concat('10.0.0.', k) END"

# The same view for the SQL side; starts a WITH list.
TRACE_SQL = f"""
WITH trace AS (
  SELECT *, event_id - min(event_id) OVER (PARTITION BY epoch) + 1 AS event_sequence
  FROM (
    SELECT event_id, ts AS event_time, user_id AS session_id, event_type, value, k,
           CAST(date_trunc('week', ts) AS TIMESTAMP) AS epoch,
           'T_0_' || strftime(ts, '%Y%m%d') || '.xml' AS file_name,
           CAST(extract(hour FROM ts) AS BIGINT) AS file_offset,
           event_type = 'signup' AS is_login
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  )
), logins AS (
  SELECT session_id, epoch, event_sequence, event_id, event_time, file_name,
         {ADDRESS} AS client_net_address,
         'app_' || CAST(session_id % 7 AS VARCHAR) AS client_app_name
  FROM trace WHERE is_login
), statements AS (
  SELECT * FROM trace WHERE NOT is_login
), live AS (
  SELECT c_custkey AS session_id, c_mktsegment AS program_name, c_name AS client_net_address
  FROM customer WHERE c_acctbal > 0
)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _week(c: str):
    return F.date_trunc("week", F.col(c)).cast("timestamp_ntz")


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace without event sequences."""
    return _rows(events(spark, sf_dir))


def _rows(source: DataFrame) -> DataFrame:
    return source.select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.col("user_id").alias("session_id"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        _week("ts").alias("epoch"),
        F.concat(F.lit("T_0_"), F.date_format("ts", "yyyyMMdd"), F.lit(".xml")).alias("file_name"),
        F.hour("ts").cast("long").alias("file_offset"),
        (F.col("event_type") == "signup").alias("is_login"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = events(spark, sf_dir)
    firsts = source.groupBy(_week("ts").alias("epoch")).agg(F.min("event_id").alias("first_id"))
    numbered = _rows(source).join(firsts, "epoch")
    return numbered.withColumn("event_sequence", F.col("event_id") - F.col("first_id") + 1).drop("first_id")


def logins(trace: DataFrame) -> DataFrame:
    return trace.where("is_login").select(
        "session_id",
        "epoch",
        *[c for c in ("event_sequence",) if c in trace.columns],
        "event_id",
        "event_time",
        "file_name",
        F.expr(ADDRESS).alias("client_net_address"),
        F.concat(F.lit("app_"), F.col("session_id") % 7).alias("client_app_name"),
    )


def statements(trace: DataFrame) -> DataFrame:
    return trace.where(~F.col("is_login"))


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("session_id"),
        F.col("c_mktsegment").alias("program_name"),
        F.col("c_name").alias("client_net_address"),
    )


# --- the trace as the capture side exports it -------------------------------------------------------------


def statement_text(k="k", session="session_id", event_type="event_type"):
    return F.concat(
        F.lit("SELECT x FROM t WHERE kind = '"),
        F.col(event_type),
        F.lit("' AND a < "),
        (F.col(k) % 5).cast("string"),
        F.lit(" /* by "),
        F.col(session).cast("string"),
        F.lit(" */"),
    )


STATEMENT_SQL = """
'SELECT x FROM t WHERE kind = ''' || event_type || ''' AND a < ' || CAST(k % 5 AS VARCHAR)
|| ' /* by ' || CAST(session_id AS VARCHAR) || ' */'
"""


def _node(kind: str, name: str, value):
    return F.coalesce(
        F.concat(F.lit(f'<{kind} name="{name}"><value>'), value.cast("string"), F.lit(f"</value></{kind}>")), F.lit("")
    )


def _escaped(text):
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def raw_trace(trace: DataFrame) -> DataFrame:
    """Raw events with their XML: logins as hex payloads, statements with text and counters."""
    payload = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit("user_"), F.col("session_id")).alias("LoginName"),
                F.col("event_time").cast("string").alias("LoginTime"),
                F.col("session_id").cast("int").alias("spid"),
                F.expr(ADDRESS).alias("client_net_address"),
                F.concat(F.lit("app_"), F.col("session_id") % 7).alias("client_app_name"),
            )
        )
    )
    kind = F.when(F.col("is_login"), "user_event").when(F.col("event_type") == "click", "rpc_completed")
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    statement_only = F.when(~F.col("is_login"), F.lit(True))

    def only(value):
        return F.when(statement_only, value)

    body = [
        _node("data", "user_data", F.when(F.col("is_login"), text_to_utf16_hex(payload))),
        _node("data", "statement", only(_escaped(statement_text()))),
        _node("data", "duration", only((F.col("value") * 100).cast("long"))),
        _node("data", "cpu_time", only(F.col("k") * 2)),
        _node("data", "logical_reads", only(F.when(F.col("k") % 3 != 0, F.col("k")))),
        _node("data", "writes", only(F.col("k") % 4)),
        _node("data", "row_count", only(F.col("k") + 1)),
        _node("action", "event_sequence", F.col("event_sequence")),
        _node("action", "server_principal_name", only(F.concat(F.lit("user_"), F.col("session_id")))),
        _node("action", "session_id", only(F.col("session_id"))),
        _node("action", "database_name", only(F.when(F.col("k") % 2 == 0, F.concat(F.lit("db_"), F.col("k") % 3)))),
    ]
    xml = F.concat(
        F.lit('<event name="'),
        F.coalesce(kind, F.lit("sql_statement_completed")),
        F.lit('" timestamp="'),
        stamp,
        F.lit('Z">'),
        *body,
        F.lit("</event>"),
    )
    # Building and parsing XML is dear: small tables, read as one partition, are dealt out before it.
    dealt = trace.repartition(trace.sparkSession.sparkContext.defaultParallelism)
    return dealt.select("file_name", "file_offset", xml.alias("event_data"))


def write_trace_files(raw: DataFrame, folder: str, share: float) -> None:
    """The files of a raw trace as the capture side writes them, up to a share of their bytes.

    One task writes one file, as its rows come out of the sort: a batch of them is in memory, however large the file is.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, left = None, None, 0
        try:
            for batch in batches:
                for file, size, text in zip(*(batch.column(c).to_pylist() for c in ("file_name", "size", "event_data")), strict=True):
                    if out is None or file != name:
                        if out is not None:
                            out.close()
                        name, left = file, int(size * share)
                        store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(path, buffer_size=WRITE_BYTES)
                    if left > 0:
                        body = text.encode()[:left]
                        out.write(body)
                        left -= len(body)
        finally:
            if out is not None:
                out.close()
        yield from ()

    # A row for each file.
    sizes = raw.groupBy("file_name").agg(F.sum(F.octet_length("event_data")).alias("size")).withColumnRenamed("file_name", "sized")
    sequence = F.regexp_extract("event_data", 'event_sequence"><value>(\\d+)', 1).cast("long")
    rows = raw.withColumn("sequence", sequence).join(F.broadcast(sizes), F.col("file_name").eqNullSafe(F.col("sized")))
    rows = rows.repartition("file_name").sortWithinPartitions("file_name", "file_offset", "sequence")
    rows.select("file_name", "size", "event_data").mapInArrow(write, "file_name string").write.format("noop").mode("overwrite").save()


# What the raw trace must turn into.
PROJECTED_SQL = f"""
, projected AS (
  SELECT event_id, file_name, event_sequence, event_time, epoch, CAST(session_id AS INTEGER) AS session_id,
         'user_' || CAST(session_id AS VARCHAR) AS server_principal_name,
         CASE WHEN k % 2 = 0 THEN 'db_' || CAST(k % 3 AS VARCHAR)
              ELSE 'nom de base de données absent' END AS database_name,
         {STATEMENT_SQL} AS statement,
         CAST(trunc(value * 100) AS BIGINT) AS dur_micro_sec, k * 2 AS cpu_time,
         CASE WHEN k % 3 <> 0 THEN k END AS logical_reads, k % 4 AS writes, k + 1 AS row_count,
         CAST(NULL AS BIGINT) AS physical_reads
  FROM statements
)
"""
