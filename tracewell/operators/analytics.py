"""Analyst questions on logins, audited statements and job history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.times import display_time, utc_date
from tracewell.plans.asof import DEFAULT_BUCKET_ROWS, previous_value

# Job run codes.
RUN_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled", 4: "In Progress"}

# "SELECT Fen=<digits>,Seq=<digits>", perhaps after one comment; numbers are usually padded to 3 and 5 digits.
NUMBERED_STATEMENT = r"^(?:/\*[^*]*\*/)?SELECT Fen=([0-9]+),Seq=([0-9]+)(?![0-9])"


def host_most_used(
    logins: DataFrame,
    n: int = 10,
    login: str = "login_name",
    address: str = "client_net_address",
    at: str = "login_time",
    tie: str = "event_sequence",
) -> DataFrame:
    """The address each login used most in its last ``n`` logins; ties go to the later login, then by name.

    Only the best ``n`` rows per login and map task are shuffled, so a hot login stays small.
    """
    recent = Window.partitionBy(login).orderBy(F.desc(at), F.desc(tie), address)
    uses = (
        logins.select(login, address, at, tie)
        .withColumn("rn", F.row_number().over(recent))
        .where(F.col("rn") <= n)
        .groupBy(login, address)
        .agg(F.count(F.lit(1)).alias("uses"), F.max(F.struct(at, tie)).alias("last_use"))
    )
    best = Window.partitionBy(login).orderBy(F.desc("uses"), F.desc("last_use"), address)
    return uses.withColumn("rn", F.row_number().over(best)).where(F.col("rn") == 1).select(login, address, "uses")


def find_missing_seq(
    df: DataFrame,
    group: str,
    seq: str,
    tie: str,
    diff: int = 1,
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
) -> DataFrame:
    """Rows whose step from the previous sequence of their group is not ``diff``; the first compares with 0.

    Distinct sequences are compared first (copies collapse before the shuffle), then only the rows of the
    suspect ones are fetched. Among copies, the one with the lowest ``tie`` takes the step, the others step 0.
    """
    known = df.where(F.col(group).isNotNull() & F.col(seq).isNotNull())
    values = known.groupBy(group, seq).agg(F.count(F.lit(1)).alias("__n"), F.min(tie).alias("__first"))
    values = previous_value(values, [group], seq, "bs", bucket_rows=bucket_rows)
    suspect = values.where((F.col(seq) - F.col("bs") != diff) | ((F.col("__n") > 1) & F.lit(diff != 0)))
    rows = known.join(suspect.select(group, seq, "bs", "__first"), [group, seq])
    before = F.when(F.col(tie) == F.col("__first"), F.col("bs")).otherwise(F.col(seq))
    return rows.withColumn("bs", before).where(F.col(seq) - F.col("bs") != diff).select(*df.columns, "bs")


def numbered_statements(audit: DataFrame, text: str = "statement") -> DataFrame:
    """Statements of the numbered load, with client ``f`` and number ``s``."""
    # No match gives an empty number: the filter needs no pass of its own over the text.
    number = F.regexp_extract(text, NUMBERED_STATEMENT, 2)
    return audit.withColumn("s", F.when(number != "", number).cast("long")).where(F.col("s").isNotNull()).select(
        *audit.columns, F.regexp_extract(text, NUMBERED_STATEMENT, 1).cast("int").alias("f"), "s"
    )


def sequence_holes(
    audit: DataFrame, epoch: str = "epoch", seq: str = "event_sequence", bucket_rows: int = DEFAULT_BUCKET_ROWS
) -> DataFrame:
    """Statements that do not directly follow the previous one of their epoch: logins or losses lie between."""
    return previous_value(audit, [epoch], seq, "bs", bucket_rows=bucket_rows).where(F.col(seq) - F.col("bs") != 1)


def run_status_label(code: str | Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.coalesce(*[F.when(code == k, label) for k, label in RUN_STATUS.items()])


def last_job_run(history: DataFrame, job_id=None) -> DataFrame:
    """All steps of the most recent run of each job (or of one job), with the status label.

    A run ends with its row of step 0; its steps lie between the previous end and its own.
    """
    if job_id is not None:
        history = history.where(F.col("job_id") == job_id)
    latest = Window.partitionBy("job_id").orderBy(F.desc("instance_id"))
    ends = (
        history.where(F.col("step_id") == 0)
        .select("job_id", "instance_id")
        .withColumn("rn", F.row_number().over(latest))
        .where(F.col("rn") <= 2)
        .groupBy("job_id")
        .agg(
            F.max("instance_id").alias("job_end"),
            F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("instance_id"))), F.lit(0)).alias("previous_end"),
        )
    )
    inside = (F.col("instance_id") > F.col("previous_end")) & (F.col("instance_id") <= F.col("job_end"))
    return (
        history.join(ends, "job_id")
        .where(inside)
        .select(*history.columns, run_status_label("run_status").alias("status"))
    )


def job_status_report(history: DataFrame, job_id=None) -> DataFrame:
    """Per job a header row, then the messages of its last run; order by ``job_id`` and ``ordinal``."""
    jobs = history if job_id is None else history.where(F.col("job_id") == job_id)
    header = (
        jobs.where(F.col("step_id") == 0)
        .select("job_id")
        .distinct()
        .select(
            "job_id",
            F.lit(0).cast("long").alias("ordinal"),
            F.lit(None).cast("string").alias("status"),
            F.concat(F.lit("Status from previous "), F.col("job_id"), F.lit(" job execution ")).alias("msgs"),
        )
    )
    return header.unionByName(
        last_job_run(jobs).select(
            "job_id",
            F.col("instance_id").cast("long").alias("ordinal"),
            "status",
            F.concat("message", F.lit("\r\n")).alias("msgs"),
        )
    )


def job_needs_attention(history: DataFrame, job_id=None) -> DataFrame:
    """Steps of the last run that did not succeed. The report's header row is not a step."""
    return last_job_run(history, job_id).where(F.col("status").isNull() | (F.col("status") != "Succeeded"))


def daily_weekday_counts(audit: DataFrame, at: str = "event_time", display_tz: str | None = None) -> DataFrame:
    """Statements per day and weekday, days taken in ``display_tz`` when given."""
    wall = display_time(at, display_tz) if display_tz else F.col(at)
    return (
        audit.select(F.to_date(wall).alias("event_date"))
        .groupBy("event_date")
        .agg(F.count(F.lit(1)).alias("nb_qry"))
        .select("event_date", F.date_format("event_date", "EEEE").alias("week_day"), "nb_qry")
    )


def browse_audit(
    audit: DataFrame,
    since=None,
    until=None,
    principal: str | None = None,
    from_live_view: bool | None = None,
    at: str = "event_time",
    date_column: str = "event_date",
) -> DataFrame:
    """Audit rows by time, user and provenance. Time bounds also bound the partition dates, which prunes the scan."""
    if since is not None:
        audit = audit.where(F.col(at) >= F.lit(since))
        if date_column in audit.columns:
            audit = audit.where(F.col(date_column) >= utc_date(F.lit(since)))
    if until is not None:
        audit = audit.where(F.col(at) < F.lit(until))
        if date_column in audit.columns:
            audit = audit.where(F.col(date_column) <= utc_date(F.lit(until)))
    if principal is not None:
        audit = audit.where(F.col("server_principal_name") == principal)
    if from_live_view is not None:
        live = F.col("client_net_address").startswith("(Cur)")
        audit = audit.where(live if from_live_view else ~live)
    return audit


def event_trace_map(
    events: DataFrame, event_map: DataFrame, bindings: DataFrame, columns: DataFrame, action_map: DataFrame
) -> DataFrame:
    """Which trace column and action stand behind each event class: joins over distinct bindings, each row once.

    Each table is made distinct before the joins, while its rows are narrow: a class with bindings then comes out distinct,
    because its number is in the result. Classes without a binding lose theirs and are few: only they are made distinct again.
    """
    bound = bindings.select("trace_event_id", "trace_column_id").distinct()
    named = columns.select("trace_column_id", F.col("name").alias("sql_trace_column")).distinct()
    actions = action_map.select("trace_column_id", F.col("xe_action_name").alias("extended_events_action")).distinct()
    mapped = event_map.select(
        F.col("trace_event_id").alias("mapped_id"),
        F.col("package_name").alias("package"),
        F.col("xe_event_name").alias("x_event_name"),
    ).distinct()
    classes = events.select(F.col("trace_event_id").alias("event_id"), F.col("name").alias("event_class")).distinct()
    known = classes.join(mapped, F.col("event_id") == F.col("mapped_id"), "left")
    out = ["trace_event_id", "event_class", "package", "x_event_name", "trace_column_id", "sql_trace_column", "extended_events_action"]
    met = (
        known.join(bound, F.col("mapped_id") == F.col("trace_event_id"))
        .join(named, "trace_column_id", "left")
        .join(actions, "trace_column_id", "left")
        .select(*out)
    )
    numbers = bindings.select("trace_event_id").distinct()
    unmet = known.join(numbers, F.col("mapped_id") == F.col("trace_event_id"), "left_anti")
    unmet = unmet.select("event_class", "package", "x_event_name").distinct()
    return met.unionByName(unmet, allowMissingColumns=True)


def pivot_actions(df: DataFrame, key: Sequence[str], action: str, value: str, actions: Sequence[str]) -> DataFrame:
    """One column per listed action holding the greatest value of that action."""
    return df.groupBy(*key).pivot(action, list(actions)).agg(F.max(value))


def unpivot_actions(df: DataFrame, key: Sequence[str], actions: Sequence[str], action: str, value: str) -> DataFrame:
    return df.unpivot(list(key), list(actions), action, value)


def json_array_rows(df: DataFrame, array: str, item: str = "item") -> DataFrame:
    """One row per element of an array column; rows without elements stay, with NULL."""
    return df.withColumn(item, F.explode_outer(array))
