"""What to keep, what may go, and what went missing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.model import LOST_FILE_PREFIX, RETENTION_DAYS
from tracewell.operators.epochs import rank_epochs


def cutoff(as_of: dt.datetime | Column, days: int = RETENTION_DAYS) -> Column:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return as_of - F.expr(f"INTERVAL {days} DAYS")


def prune_connections(
    logins: DataFrame, session: str = "session_id", epoch: str = "epoch", seq: str = "event_sequence"
) -> DataFrame:
    """Only the newest login of each (session, epoch). Aggregated before the shuffle, so hot sessions are harmless."""
    rest = [c for c in logins.columns if c not in (session, epoch, seq)]
    newest = logins.groupBy(session, epoch).agg(F.max(F.struct(seq, *rest)).alias("newest"))
    return newest.select(session, epoch, "newest.*").select(*logins.columns)


def retain(
    df: DataFrame,
    at: str,
    as_of: dt.datetime | Column,
    days: int = RETENTION_DAYS,
    max_rows: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Rows not older than ``days``; rows without a time stay.

    ``max_rows`` bounds how many rows one pass removes, oldest first (``order`` breaks ties).
    """
    limit = cutoff(as_of, days)
    expired = F.coalesce(F.col(at) < limit, F.lit(False))
    if max_rows is None:
        return df.where(~expired)
    keys = F.struct(at, *(order or []))
    last = (
        df.where(expired)
        .select(keys.alias("k"))
        .orderBy("k")
        .limit(max_rows)
        .agg(F.max("k").alias("k"))
    )
    removed = expired & (keys <= last.scalar())
    return df.where(~F.coalesce(removed, F.lit(False)))


def retain_epochs(
    logins: DataFrame, as_of: dt.datetime | Column, days: int = RETENTION_DAYS, epoch: str = "epoch"
) -> DataFrame:
    """Drop logins of expired epochs, but never those of the newest epoch, whatever its age, or without an epoch."""
    newest = logins.agg(F.max(epoch))
    kept = (F.col(epoch) >= cutoff(as_of, days)) | (F.col(epoch) == newest.scalar())
    return logins.where(F.col(epoch).isNull() | kept)


def epoch_retention_report(
    logins: DataFrame, as_of: dt.datetime | Column, days: int = RETENTION_DAYS, epoch: str = "epoch"
) -> DataFrame:
    """Each epoch with its rank (1 = newest), its logins and whether the epoch rule keeps it."""
    sizes = logins.groupBy(epoch).agg(F.count(F.lit(1)).alias("logins"))
    kept = (F.col("session_history_rank") == 1) | (F.col(epoch) >= cutoff(as_of, days))
    return sizes.join(rank_epochs(sizes, epoch), epoch).withColumn("kept", kept)


def retain_connections(
    logins: DataFrame,
    as_of: dt.datetime | Column,
    days: int = RETENTION_DAYS,
    keep_open_sessions: bool = False,
    at: str = "login_time",
) -> DataFrame:
    """The epoch rule, then the age of each login. ``keep_open_sessions`` spares the newest login per session and epoch."""
    kept = retain_epochs(logins, as_of, days)
    if not keep_open_sessions:
        return retain(kept, at, as_of, days)
    newest = kept.groupBy("session_id", "epoch").agg(F.max("event_sequence").alias("__newest"))
    newest = newest.select(F.col("session_id").alias("__session"), F.col("epoch").alias("__epoch"), "__newest")
    young = F.coalesce(F.col(at) >= cutoff(as_of, days), F.lit(True))
    same = F.col("session_id").eqNullSafe(F.col("__session")) & F.col("epoch").eqNullSafe(F.col("__epoch"))
    return (
        kept.join(newest, same)
        .where(young | (F.col("event_sequence") == F.col("__newest")))
        .select(*logins.columns)
    )


def lost_files(checkpoints: DataFrame, listing: DataFrame, path: str = "path", latest_only: bool = True) -> DataFrame:
    """Messages for checkpointed files that are no longer there: the latest one, or any."""
    if latest_only:
        order = F.struct("chk_point_time", "file_name")
        read = checkpoints.agg(F.max_by("file_name", order).alias("file_name")).dropna()
    else:
        read = checkpoints.select("file_name")
    gone = read.subtract(listing.select(F.col(path).alias("file_name")))
    return gone.select("file_name", F.concat(F.lit(LOST_FILE_PREFIX), F.col("file_name")).alias("msg"))


def disposable_files(listing: DataFrame, path: str = "path") -> DataFrame:
    """The first file by name, provided another follows it: the newest file is never disposable."""
    return (
        listing.agg(F.min(path).alias(path), F.count(F.lit(1)).alias("nb_files"))
        .where(F.col("nb_files") > 1)
    )


def finished_files(listing: DataFrame, checkpoints: DataFrame, path: str = "path") -> DataFrame:
    """Files before the one being read."""
    current = checkpoints.agg(F.max_by("file_name", F.struct("chk_point_time", "file_name")).alias("file_name"))
    return listing.where(F.col(path) < current.scalar())


def freshness(
    audit: DataFrame, as_of: dt.datetime | Column, max_silence: str = "INTERVAL 15 MINUTES", at: str = "event_time"
) -> DataFrame:
    """Per epoch: first and last event, events, and whether the newest epoch has fallen silent."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    epochs = audit.groupBy("epoch").agg(
        F.min(at).alias("first_event"), F.max(at).alias("last_event"), F.count(F.lit(1)).alias("events")
    )
    current = audit.agg(F.max("epoch")).scalar()
    silent = (F.col("epoch") == current) & (F.col("last_event") < as_of - F.expr(max_silence))
    return epochs.withColumn("silent", F.coalesce(silent, F.lit(False)))

