"""The audit as a stream of trace files.

Each micro-batch is parsed once into the ``events`` table. Files normally arrive in name order; then the
statements of the batch are attributed against a small state (newest login per session and epoch) and appended
where they are new. The file source does not promise that order. A batch with an earlier file than one already
done is *late*. Its statements are attributed against all logins and appended where they are new. A login it brings changes
the stored statements of its session up to the next login of that session, and no others: these are found by an as-of
join of keys alone, and the date partitions that hold them are replaced. Only a restart not known before, which moves
all that follows it to another epoch, makes every statement from its file on be attributed again from the stored events.
A restored file replaces nothing. In each case the table equals what one batch over all files gives.

What is stored is read for duplicates only where it can hold any: each batch notes the range of sequences by epoch and
date, and a batch whose ranges meet none of those before reads no stored statement. (A watermark would do this in the
stream itself, but drops the late events that this table must take.)

Everything a batch writes lies under its own number and is overwritten when the batch is run again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.times import utc_date
from tracewell.model import (
    CHECKPOINT,
    CONNECTIONS,
    EVENT_XML,
    FULL_AUDIT,
    LIVE_PREFIX,
    LIVE_SESSIONS,
    NO_ADDRESS,
    NO_PROGRAM,
    PROCESS_LOG,
    RAW_EVENT,
    AuditConfig,
)
from tracewell.operators.attribution import attribute_with_fallback, login_intervals, reattributed
from tracewell.operators.epochs import assign_epoch, trace_starts
from tracewell.operators.events import extract_statements, flatten_events, judged_logins, split_judged
from tracewell.operators.lifecycle import lost_files, prune_connections, retain, retain_connections
from tracewell.plans.audit import AUDIT_KEY, LOGIN_KEY
from tracewell.session import new_work_path, write_and_read
from tracewell.sources import tables
from tracewell.sources.generations import Generations
from tracewell.sources.tail import FORMAT, tail_stream
from tracewell.sources.trace import parse_trace_events, trace_xml_events
from tracewell.streaming.pace import Pace, query_name, watch_silence

_STARTS = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("epoch", T.TimestampType())])
_PROGRESS = T.StructType(
    [
        *CHECKPOINT.fields,
        T.StructField("newest_event", T.TimestampType()),
        T.StructField("statements", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
#: Most bytes of a packed file, and how it is written: row groups that a look-up can leave out, by range or by bloom filter.
FILE_BYTES = 256 << 20
#: Bytes of the rows of a packed file, which one task sorts: its texts, and for each row its other columns.
TASK_BYTES, ROW_BYTES = 256 << 20, 300
PACKED = {
    "parquet.block.size": str(8 << 20),
    "parquet.bloom.filter.enabled#server_principal_name": "true",
    "parquet.bloom.filter.enabled#client_net_address": "true",
}
#: Batches whose logins are kept apart before they are merged into one state.
MERGE_EVERY = 16
#: Batch number of the logins that outlive the batches they came in.
_SPARED = -1
_STORED_AUDIT = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        *FULL_AUDIT.fields,
        T.StructField("source", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)
_RANGES = T.StructType(
    [
        T.StructField("epoch", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
    ]
)
_LOGIN_EVENTS = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        *[f for f in CONNECTIONS.fields if f.name != "epoch"],
    ]
)


_ANSWER = ("client_net_address", "client_app_name", "source")


def _event_date() -> Column:
    return utc_date("event_time")


def _ranges(statements: DataFrame) -> DataFrame:
    """First and last sequence by epoch and event_date; rows without a key equal nothing and are left out."""
    keyed = statements.where(F.col("epoch").isNotNull() & F.col("event_sequence").isNotNull() & F.col("event_date").isNotNull())
    sequence = F.col("event_sequence")
    return keyed.groupBy("epoch", "event_date").agg(F.min(sequence).alias("first"), F.max(sequence).alias("last"))


def _as_said(answered: DataFrame, said_live: Column) -> DataFrame:
    """Where the live view once gave an answer, it stands unless a login is known by now: the view has moved on since.

    A login may name a program and no address: what it names stands, the rest is as it was said.
    """
    def guess(c: str, at: str) -> Column:
        if c == "source":
            return F.col(at) != "asof"
        return F.col(at).startswith(LIVE_PREFIX) | F.col(at).isin(NO_ADDRESS, NO_PROGRAM)

    # A program that an other login named, and not the live view, is no answer of the live view.
    return answered.withColumns(
        {c: F.when(said_live & guess(c, c) & guess(c, f"said_{c}"), F.col(f"said_{c}")).otherwise(F.col(c)) for c in _ANSWER}
    )


class AuditStore:
    """Tables of one audit under one shared folder."""

    def __init__(self, spark: SparkSession, path: str, config: AuditConfig = AuditConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def parts(self, spark: SparkSession | None = None) -> Generations:
        """The audit by date; each change of it becomes visible at once."""
        return Generations(spark or self.spark, self._at("audit"), _STORED_AUDIT, "event_date")

    def stored_audit(self, spark: SparkSession | None = None) -> DataFrame:
        return self.parts(spark).read()

    def audit(self) -> DataFrame:
        return self.stored_audit().drop("file_name")

    def logins(
        self, spark: SparkSession | None = None, starts: DataFrame | None = None, before: int | None = None
    ) -> DataFrame:
        """All logins seen (``before`` a batch), each once, with its epoch."""
        spark = spark or self.spark
        batch = T.StructField("batch_id", T.LongType())
        seen = tables.read_or_empty(spark, self._at("logins"), T.StructType([*_LOGIN_EVENTS.fields, batch]))
        if before is not None:
            seen = seen.where(F.col("batch_id") < before)
        starts = starts if starts is not None else self.state(spark, "starts", _STARTS)
        dated = assign_epoch(seen, starts, self.config.initial_epoch)
        return dated.select(*CONNECTIONS.names).distinct()

    def quarantine(self) -> DataFrame:
        return self.spark.read.parquet(self._at("quarantine"))

    def checkpoints(self) -> DataFrame:
        """The place each batch came to; a batch that ends where an earlier one did adds nothing."""
        seen = tables.read_or_empty(self.spark, self._at("checkpoint"), _PROGRESS)
        first = F.min_by(F.struct("chk_point_time", "epoch"), "batch_id").alias("first")
        return seen.groupBy("file_name", "last_offset_done").agg(first).select(
            "file_name", "last_offset_done", "first.*"
        )

    def progress(self) -> DataFrame:
        """What each batch wrote and up to where: batch_id, statements, newest_event and its checkpoint."""
        return tables.read_or_empty(self.spark, self._at("checkpoint"), _PROGRESS)

    def log(self) -> DataFrame:
        """Messages of the process: lost files, starts, failures."""
        return tables.read_or_empty(self.spark, self._at("log"), PROCESS_LOG)

    def add_to_log(self, messages: DataFrame | str) -> None:
        if isinstance(messages, str):
            messages = self.spark.range(1).select(F.lit(messages).alias("msg"))
        tables.log_messages(messages, self._at("log"))

    def note_lost_files(self, listing: DataFrame) -> None:
        """Log the file that the newest checkpoint names, if ``listing`` (path) has it no longer."""
        names = listing.select(F.element_at(F.split("path", "[/\\\\]"), -1).alias("path"))
        gone = lost_files(self.checkpoints(), names)
        if not gone.isEmpty():
            self.add_to_log(gone)

    def state(self, spark: SparkSession, name: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        """The newest version of a state table, or the newest before a batch."""
        versions = [
            v for v in tables.partition_values(spark, self._at(name), "version") if before is None or int(v) < before
        ]
        if not versions:
            return spark.createDataFrame([], schema)
        newest = max(versions, key=int)
        return spark.read.schema(schema).parquet(f"{self._at(name)}/version={newest}")

    def _save_state(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self._at(name)}/version={version}")

    def login_state(self, spark: SparkSession | None = None, before: int | None = None) -> DataFrame:
        """The newest login of each session and epoch, before a batch: a base, and what each batch since then brought."""
        spark = spark or self.spark
        base, since = self._login_versions(spark, before)
        state = self.state(spark, "login_state", CONNECTIONS, None if base is None else base + 1)
        if base is None:
            state = spark.createDataFrame([], CONNECTIONS)
        if since:
            paths = [f"{self._at('login_increments')}/version={v}" for v in since]
            state = state.unionByName(spark.read.schema(CONNECTIONS).parquet(*paths))
        return prune_connections(state)

    def _login_versions(self, spark: SparkSession, before: int | None) -> tuple[int | None, list[int]]:
        def versions(name: str) -> list[int]:
            found = (int(v) for v in tables.partition_values(spark, self._at(name), "version"))
            return sorted(v for v in found if before is None or v < before)

        base = max(versions("login_state"), default=None)
        return base, [v for v in versions("login_increments") if base is None or v > base]

    def _note_logins(self, spark: SparkSession, own: DataFrame, all_logins: DataFrame | None, batch_id: int) -> None:
        """Add the logins of a batch to the state.

        A batch writes what it brings, so that writes keep in proportion to it; every ``MERGE_EVERY`` batches the increments become a
        new base. A late batch may have moved known logins to other epochs and writes the base from all of them.
        """
        _, since = self._login_versions(spark, batch_id)
        if all_logins is not None:
            self._save_state(prune_connections(all_logins), "login_state", batch_id)
        elif len(since) + 1 >= MERGE_EVERY:
            self._save_state(prune_connections(self.login_state(spark, batch_id).unionByName(own)), "login_state", batch_id)
        else:
            self._save_state(prune_connections(own), "login_increments", batch_id)

    def _drop_old_state(self, spark: SparkSession, version: int) -> None:
        base, _ = self._login_versions(spark, version)
        for v in tables.partition_values(spark, self._at("login_increments"), "version"):
            # A repeat of this batch starts from the base before it and what came after that.
            if base is not None and int(v) <= base:
                tables.remove(spark, f"{self._at('login_increments')}/version={v}")
        for name in ("starts", "login_state", "ranges"):
            old = sorted(int(v) for v in tables.partition_values(spark, self._at(name), "version"))
            # The version before this batch is what a repeat of the batch starts from.
            for v in [v for v in old if v < version][:-1]:
                tables.remove(spark, f"{self._at(name)}/version={v}")

    # --- one micro-batch -----------------------------------------------------------------------------------

    def process(self, parsed: DataFrame, batch_id: int, live_sessions: DataFrame | None = None) -> int:
        """Audit the events of one batch. Returns the number of statements written, counted as they are written."""
        spark = parsed.sparkSession
        if live_sessions is None:
            live_sessions = spark.createDataFrame([], LIVE_SESSIONS)

        flat = flatten_events(parsed, self.config.missing_database, self.config.writes_from_cpu_time)
        events_path = f"{self._at('events')}/batch_id={batch_id}"
        flat.write.mode("overwrite").partitionBy("event_class").parquet(events_path)
        events = spark.read.schema(flat.schema).parquet(events_path)

        place = F.struct("file_name", F.coalesce("file_offset", F.lit(0)).alias("offset"))
        first_place, last_place, newest = (
            events.where("file_name IS NOT NULL").agg(F.min(place), F.max(place), F.unix_micros(F.max("event_time"))).first()
        )
        if first_place is None:
            return 0
        first, (last, last_offset) = first_place[0], last_place
        progress = tables.read_or_empty(spark, self._at("checkpoint"), _PROGRESS)
        done = F.max(F.struct("file_name", "last_offset_done"))
        before = progress.where(F.col("batch_id") < batch_id).agg(done).first()[0]
        # Parts of one file that do not begin after what is done are late like an earlier file.
        late = before is not None and tuple(first_place) <= tuple(before)

        known = self.state(spark, "starts", _STARTS, batch_id)
        merged = known.unionByName(trace_starts(events)).groupBy("file_name").agg(F.min("epoch").alias("epoch"))
        self._save_state(merged, "starts", batch_id)
        starts = self.state(spark, "starts", _STARTS, batch_id + 1)

        dated = assign_epoch(events, starts, self.config.initial_epoch)
        # Payloads are decoded once for both tables.
        work = new_work_path(spark, "judged")
        found, unusable = split_judged(write_and_read(judged_logins(events), work))
        found.select(*_LOGIN_EVENTS.names).write.mode("overwrite").parquet(f"{self._at('logins')}/batch_id={batch_id}")
        unusable.write.mode("overwrite").parquet(f"{self._at('quarantine')}/batch_id={batch_id}")
        tables.remove(spark, work)

        own = spark.read.schema(_LOGIN_EVENTS).parquet(f"{self._at('logins')}/batch_id={batch_id}")
        own = assign_epoch(own, starts, self.config.initial_epoch).select(*CONNECTIONS.names)
        work = new_work_path(spark, "logins")
        if late:
            # Dated and made distinct once: intervals, attribution and state all read them, some of them several times.
            logins = write_and_read(self.logins(spark, starts), work)
        else:
            # What went before is needed only as the newest login per session and epoch, and of the sessions at hand.
            sessions = extract_statements(events).select("session_id").distinct()
            logins = self.login_state(spark, batch_id).join(sessions, "session_id", "left_semi").unionByName(own)

        written = Observation()
        # What an earlier attempt at this batch appended does not count as stored.
        self.parts(spark).take_back(f"batch-{batch_id}")
        appended = not (late and not starts.exceptAll(known).isEmpty())
        if not appended:
            self._replace_from(spark, first, starts, logins, live_sessions, batch_id)
            self._save_state(self._stored_ranges(spark), "ranges", batch_id)
        else:
            if late:
                self._amend(spark, own, logins, self.logins(spark, starts, before=batch_id), live_sessions, batch_id)
            stored = self._stored_keys(spark, extract_statements(dated), batch_id)
            fresh = self._attributed(dated, logins, live_sessions, stored)
            fresh = fresh.observe(written, F.count(F.lit(1)).alias("statements"))
            # Few files per date for a small batch, more for a large one.
            self.parts(spark).append(fresh.hint("rebalance", "event_date"), f"batch-{batch_id}")
        self._note_logins(spark, own, logins if late else None, batch_id)
        tables.remove(spark, work)

        statements = written.get["statements"] if appended else None
        # Last of all, so that a batch counts as done only when all it writes is there.
        place = spark.range(1).select(
            F.lit(last).alias("file_name"),
            F.lit(last_offset).cast("long").alias("last_offset_done"),
            F.current_timestamp().alias("chk_point_time"),
            F.timestamp_micros(F.lit(newest).cast("long")).alias("newest_event"),
            F.lit(statements).cast("long").alias("statements"),
        )
        place = assign_epoch(place, starts, self.config.initial_epoch)
        place.write.mode("overwrite").parquet(f"{self._at('checkpoint')}/batch_id={batch_id}")
        self._drop_old_state(spark, batch_id)
        return statements or 0

    def _stored_ranges(self, spark: SparkSession) -> DataFrame:
        """The range of sequences by epoch and date of all that is stored."""
        return _ranges(self.stored_audit(spark))

    def _stored_keys(self, spark: SparkSession, statements: DataFrame, batch_id: int) -> DataFrame | None:
        """Keys already audited that a batch may hold again; None when there can be none. Equal keys have equal dates.

        The ranges of the batch are noted before it is appended: if it is run again, they say that its rows may be there.
        """
        noted = [int(v) for v in tables.partition_values(spark, self._at("ranges"), "version")]
        stored = self.stored_audit(spark)
        before = self.state(spark, "ranges", _RANGES, batch_id + 1)
        if not noted and self.parts(spark).live():
            before = self._stored_ranges(spark)  # a table written by a version that noted none
        work = [new_work_path(spark, "ranges"), new_work_path(spark, "ranges")]
        # A row for each epoch and date.
        own = write_and_read(_ranges(statements.withColumn("event_date", _event_date())), work[0])
        hull = [F.min("first").alias("first"), F.max("last").alias("last")]
        merged = write_and_read(before.unionByName(own).groupBy("epoch", "event_date").agg(*hull), work[1])
        other = before.withColumnsRenamed({"first": "stored_first", "last": "stored_last"})
        meeting = own.join(other, ["epoch", "event_date"]).where("first <= stored_last AND last >= stored_first")
        lowest, highest = meeting.agg(F.min("first"), F.max("last")).first()
        self._save_state(merged, "ranges", batch_id)
        for path in work:
            tables.remove(spark, path)
        if lowest is None:
            return None
        dates = _event_date().alias("event_date")
        near = tables.touching(stored, statements.select(dates), "event_date")
        near = near.where(F.col("event_sequence").between(lowest, highest))
        return near.select("session_id", "epoch", "event_sequence")

    def _attributed(
        self, dated: DataFrame, logins: DataFrame, live_sessions: DataFrame, stored: DataFrame | None = None
    ) -> DataFrame:
        out = attribute_with_fallback(
            extract_statements(dated),
            logins,
            live_sessions,
            self.config.bucket_rows,
            drop_repeats=True,
            stored=stored,
        )
        return out.select("file_name", *FULL_AUDIT.names, "source", _event_date().alias("event_date"))

    def _replace_from(
        self,
        spark: SparkSession,
        first: str,
        starts: DataFrame,
        logins: DataFrame,
        live_sessions: DataFrame,
        batch_id: int,
    ) -> None:
        """Attribute again everything from file ``first`` on and replace the date partitions it touches, all at once."""
        events = spark.read.parquet(self._at("events")).where(F.col("file_name") >= first).drop("batch_id")
        stored = self.stored_audit(spark)
        dated = assign_epoch(events, starts, self.config.initial_epoch)
        again = self._attributed(dated, logins, live_sessions)
        said = stored.where((F.col("file_name") >= first) & (F.col("source") == "live")).select(
            *AUDIT_KEY, F.struct("client_net_address", "client_app_name", "source").alias("said")
        )
        # A row that moves to another epoch has another key. What can meet none is left out, and where nothing is left
        # the statements are not shuffled for it.
        work = new_work_path(spark, "said")
        said = write_and_read(said.join(dated.select("epoch").distinct(), "epoch", "left_semi").select(*said.columns), work)
        if not said.isEmpty():
            again = again.join(said, AUDIT_KEY, "left").select("*", *(F.col("said")[c].alias(f"said_{c}") for c in _ANSWER))
            again = _as_said(again, F.col("said").isNotNull())
        touched = (
            extract_statements(dated)
            .select(_event_date().alias("event_date"))
            .union(stored.where(F.col("file_name") >= first).select("event_date"))
            .distinct()
        )
        # Rows of earlier files in those dates are kept. Dates are few, so this join moves nothing.
        kept = tables.touching(stored.where(F.col("file_name") < first), touched, "event_date")
        whole = kept.select(*_STORED_AUDIT.names).unionByName(again.select(*_STORED_AUDIT.names)).hint("rebalance", "event_date")
        self.parts(spark).replace(whole, f"repair-{batch_id}")
        tables.remove(spark, work)

    def _amend(
        self,
        spark: SparkSession,
        own: DataFrame,
        logins: DataFrame,
        known: DataFrame,
        live_sessions: DataFrame,
        batch_id: int,
    ) -> None:
        """Give the stored statements in the intervals of late logins their answer, and replace the dates that hold them."""
        work = new_work_path(spark, "amended")
        amended = self._amended(spark, own, logins, known, live_sessions)
        if amended is None:
            return
        amended = write_and_read(amended.dropDuplicates(LOGIN_KEY), work)
        if not amended.isEmpty():
            dated = tables.touching(self.stored_audit(spark), amended, "event_date")
            said = amended.select(*LOGIN_KEY, F.struct(*_ANSWER).alias("now"))
            # An amended statement is one row by its key; which side moves is Spark's choice by size.
            found, now = dated.join(said, LOGIN_KEY, "left"), F.col("now")
            found = found.withColumns({c: F.when(now.isNotNull(), now[c]).otherwise(F.col(c)) for c in _ANSWER})
            self.parts(spark).replace(found.hint("rebalance", "event_date"), f"repair-{batch_id}")
        tables.remove(spark, work)

    def _amended(
        self, spark: SparkSession, own: DataFrame, logins: DataFrame, known: DataFrame, live_sessions: DataFrame
    ) -> DataFrame | None:
        """Keys, dates and new answers of the stored statements that logins of a late batch change; None without a new login.

        Only keys are read, of the sessions and of the range of (epoch, sequence) that the logins can reach.
        """
        drafts = [new_work_path(spark, "new_logins"), new_work_path(spark, "intervals")]
        new = write_and_read(tables.not_stored(own, known, LOGIN_KEY), drafts[0])
        sessions = new.select("session_id").distinct()
        intervals = login_intervals(new, logins.join(sessions, "session_id", "left_semi"), self.config.bucket_rows)
        intervals = write_and_read(intervals, drafts[1])
        tables.remove(spark, drafts[0])
        place = F.struct("epoch", "event_sequence")
        # An instant goes to the driver and back as microseconds, whatever its zone there.
        bounds = intervals.agg(
            F.unix_micros(F.min("epoch")), F.count("*"), F.count("until"), F.unix_micros(F.max("until")["epoch"]), F.max("until")["event_sequence"]
        ).first()
        lowest, n, ended, last_epoch, last_sequence = bounds
        if not n:
            return None
        stored = self.stored_audit(spark).where(F.col("epoch") >= F.timestamp_micros(F.lit(lowest)))
        if n == ended:
            last = F.struct(F.timestamp_micros(F.lit(last_epoch)).alias("epoch"), F.lit(last_sequence).cast("long").alias("event_sequence"))
            stored = stored.where((F.col("epoch") <= F.timestamp_micros(F.lit(last_epoch))) & (place <= last))
        # What was said before is kept under other names beside the new answer.
        said = [F.col(c).alias(f"said_{c}") for c in _ANSWER]
        keys = stored.select(*LOGIN_KEY, "event_date", *said)
        return _as_said(reattributed(keys, intervals, live_sessions, self.config.bucket_rows), F.col("said_source") == "live")

    def compact(
        self, before: dt.date, least_generations: int = 2, bytes_per_file: int = FILE_BYTES, bytes_per_task: int = TASK_BYTES
    ) -> list[str]:
        """Pack the closed dates before ``before`` into few files, clustered by user. Run it while the stream rests.

        Dates that lie in fewer generations than ``least_generations`` are packed already. Inside a date the files are ranges
        of user and address, of ``bytes_per_file`` at most and of rows of about ``bytes_per_task``, sorted, with small row groups and bloom filters on both, so that a look-up by either reads few of them.
        Readers see a date as it was or packed, never both; ``vacuum`` removes the old files. Returns the dates packed.
        """
        parts = self.parts()
        dates = [d for d in parts.values() if d < before.isoformat() and parts.generations(d) >= least_generations]
        if dates:
            rows = parts.read(dates)
            size = tables.size(self.spark, rows.inputFiles())
            key = ["event_date", "server_principal_name", "client_net_address", "event_time"]
            texts = [f.name for f in _STORED_AUDIT if isinstance(f.dataType, T.StringType)]
            # Files are compressed, sometimes to a fiftieth: a task sorts rows, so their own size bounds it too.
            held = rows.agg(F.count("*") * ROW_BYTES + F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)))).first()[0]
            pieces = max(1, -(-size // bytes_per_file), -(-(held or 0) // bytes_per_task))
            packed = rows.repartitionByRange(pieces, *key).sortWithinPartitions(*key)
            parts.replace(packed, f"packed-{before.isoformat()}", dates, PACKED)
        return dates

    def vacuum(self) -> int:
        """Remove files of the audit that no reader needs that begins now. Returns the number of partition folders removed."""
        return self.parts().vacuum()

    def apply_retention(self, as_of: dt.datetime) -> list[str]:
        """Forget what is older than the retention, seen from ``as_of`` (UTC). Run it while the stream rests.

        Returns the audit dates dropped.
        """
        spark, config = self.spark, self.config
        cutoff = as_of - dt.timedelta(days=config.retention_days)
        instant = F.timestamp_micros(F.lit(int(cutoff.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)))
        progress = tables.read_or_empty(spark, self._at("checkpoint"), _PROGRESS)
        # Each batch noted its newest event, so nothing but the expired batch numbers is read.
        expired = [r.batch_id for r in progress.where(F.col("newest_event") < instant).select("batch_id").collect()]
        base, since = self._login_versions(spark, None)
        if base is not None or since:
            state = self.login_state(spark)
            now = instant + F.expr(f"INTERVAL {config.retention_days} DAYS")
            kept = retain_connections(
                state.withColumn("at", F.col("login_time").cast("timestamp")),
                now,
                config.retention_days,
                config.keep_open_sessions,
                at="at",
            )
            work = new_work_path(spark, "login_state")
            kept = write_and_read(kept.select(*CONNECTIONS.names), work)
            self._save_state(kept, "login_state", max([*since, *([] if base is None else [base])]))
            self._spare_logins(spark, kept, expired)
            tables.remove(spark, work)
        for batch in expired:
            for name in ("events", "logins", "quarantine", "raw"):
                tables.remove(spark, f"{self._at(name)}/batch_id={batch}")
        self._forget_places(spark, progress, instant)
        return self._purge(cutoff, instant)

    def _purge(self, cutoff: dt.datetime, instant: Column) -> list[str]:
        """Drop whole expired dates and write the one that the cutoff splits again. Undated rows stay."""
        parts, last_day = self.parts(), cutoff.date().isoformat()
        # The partition of undated rows does not sort below a date.
        dropped = [d for d in parts.values() if d < last_day]
        parts.drop(dropped)
        if last_day in parts.values():
            parts.replace(parts.read([last_day]).where(F.col("event_time") >= instant), f"purged-{last_day}", [last_day])
        parts.vacuum()
        return dropped

    def _spare_logins(self, spark: SparkSession, kept: DataFrame, expired: list[int]) -> None:
        """Logins of expired batches that the state still holds move to a batch of their own, for late files to find."""
        batch = T.StructField("batch_id", T.LongType())
        seen = tables.read_or_empty(spark, self._at("logins"), T.StructType([*_LOGIN_EVENTS.fields, batch]))
        leaving = seen.where(F.col("batch_id").isin([_SPARED, *expired])).drop("batch_id")
        dated = assign_epoch(leaving, self.state(spark, "starts", _STARTS), self.config.initial_epoch)
        spared = dated.join(kept.select(*LOGIN_KEY), LOGIN_KEY, "left_semi").select(*_LOGIN_EVENTS.names).distinct()
        work = new_work_path(spark, "spared")
        spared = write_and_read(spared, work)
        spared.write.mode("overwrite").parquet(f"{self._at('logins')}/batch_id={_SPARED}")
        tables.remove(spark, work)

    def _forget_places(self, spark: SparkSession, progress: DataFrame, instant: Column) -> None:
        """Old checkpoints but the furthest one, old log messages, and restarts that no retained event can belong to."""
        furthest = progress.agg(F.max_by("batch_id", F.struct("file_name", "last_offset_done"))).first()[0]
        old = progress.where((F.col("chk_point_time") < instant) & (F.col("newest_event") < instant)).select("batch_id")
        for row in old.collect():
            if row.batch_id != furthest:
                tables.remove(spark, f"{self._at('checkpoint')}/batch_id={row.batch_id}")
        versions = tables.partition_values(spark, self._at("starts"), "version")
        work = [new_work_path(spark, "starts"), new_work_path(spark, "log")]
        if versions:
            starts = self.state(spark, "starts", _STARTS)
            # The last restart before the cutoff still holds for the events after it.
            last = starts.where(F.col("epoch") < instant).agg(F.max("file_name")).scalar()
            kept = write_and_read(starts.where(F.coalesce(F.col("file_name") >= last, F.lit(True))), work[0])
            self._save_state(kept, "starts", max(int(v) for v in versions))
        if tables.has_data(spark, self._at("log")):
            now = instant + F.expr(f"INTERVAL {self.config.retention_days} DAYS")
            kept = write_and_read(retain(self.log(), "msg_date", now, self.config.retention_days), work[1])
            kept.write.mode("overwrite").parquet(self._at("log"))
        for path in work:
            tables.remove(spark, path)


def audit_stream(
    spark: SparkSession,
    path: str,
    store: AuditStore,
    live_sessions: DataFrame | Callable[[SparkSession], DataFrame] | None = None,
    format: str = "parquet",
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    source_options: dict[str, str] | None = None,
    pace: Pace = Pace(),
) -> StreamingQuery:
    """Start the stream: all files there are and then stop, or for ever with ``processing_time``.

    ``format`` is that of a raw event table, ``xml`` for exported trace files that are complete when they appear, or
    ``trace_tail`` for such files that still grow. ``source_options`` go to the source, for instance ``cleanSource`` of the file
    source to archive or delete finished files. A stream that runs for ever keeps the ``pace``: it waits after batches that wrote
    little, and tells in the log when nothing comes any more.
    """
    if format == "xml" and store.config.keep_raw:
        raise ValueError("raw events are kept only from a raw event table: exported files are the raw events themselves")
    reader = tail_stream(spark) if format == FORMAT else spark.readStream.format(format)
    if format == FORMAT:
        pass  # the source names its own columns
    elif format == "xml":
        reader = reader.schema(EVENT_XML).option("rowTag", "event").option("ignoreSurroundingSpaces", "false")
    else:
        reader = reader.schema(RAW_EVENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    for key, value in (source_options or {}).items():
        reader = reader.option(key, value)
    incoming = reader.load(path)
    if format == "xml":
        incoming = trace_xml_events(incoming)

    def step(batch: DataFrame, batch_id: int) -> None:
        live = live_sessions(batch.sparkSession) if callable(live_sessions) else live_sessions
        if format != "xml":
            if store.config.keep_raw:
                tables.capture_raw(batch, f"{store.path}/raw", batch_id)
            batch = parse_trace_events(batch)
        try:
            statements = store.process(batch, batch_id, live)
        except Exception as e:
            store.add_to_log(f"Batch {batch_id} failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            raise
        if processing_time:
            pace.after(statements)

    if processing_time:
        watch_silence(spark, query_name(store.path), store.add_to_log, pace)
    store.add_to_log("Audit stream started")
    writer = incoming.writeStream.foreachBatch(step).option("checkpointLocation", f"{store.path}/_stream")
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.queryName(query_name(store.path)).start() if processing_time else writer.start()
