"""Sharding by fixed virtual slots.

A record hashes into one of a fixed number of slots. Bytes are summed per slot in Spark; a small versioned table maps
slots to shards. It is stored with its version (``shard_by_stored_map``). Rebalancing edits the newest version: slots move, or trade places, between the heaviest and lighter shards,
and the edited map is the next version. Records never choose a shard by themselves, so one map edit moves whole slots.

Defined results: a null text counts no bytes; a null id hashes like any value; repeated rows share a slot and get
places one after the other; extra columns pass through, and columns named like the added ones are replaced; an empty
table gives an empty result. Places in a shard run from 0 without gaps: the slot's offset in its shard, plus the
record's number in the slot. A slot is cut further by part of a second hash, so that numbering is never one task for
a whole slot of equal ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.sources import tables

SLOTS = 4096
MAP = "version int, vslot int, shard int, bytes long, n long, first long"


def slot_of(*cols: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slot_col: str, size_col: str) -> DataFrame:
    """vslot, bytes, n: at most one row for each slot."""
    return records.groupBy(F.col(slot_col).alias("vslot")).agg(
        F.sum(size_col).alias("bytes"), F.count("*").alias("n")
    )


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 0: slots dealt round robin."""
    return np.arange(slots) % shards


def rebalance(shard_of: np.ndarray, sizes: np.ndarray, shards: int, max_edits: int | None = None) -> np.ndarray:
    """An edited copy of the map under which shard sizes are near equal.

    Each edit takes the heaviest shard and another, lightest first, and moves the slot, or swaps the two slots, that
    brings both nearest to each other. It ends when no edit lowers the heaviest shard or lifts the lightest one. Works
    on the slot table only, whose size is fixed by the number of slots.
    """
    shard_of, load = shard_of.copy(), np.bincount(shard_of, sizes, minlength=shards).astype(np.int64)
    edits = 0
    while max_edits is None or edits < max_edits:
        order = np.argsort(load, kind="stable")
        for hi, lo in [(order[-1], x) for x in order[:-1]] + [(x, order[0]) for x in order[-2:0:-1]]:
            gap = load[hi] - load[lo]
            give = np.flatnonzero((shard_of == hi) & (sizes > 0))
            if gap <= 1 or not give.size:
                continue
            take = np.flatnonzero(shard_of == lo)
            worth = np.concatenate([[0], sizes[take]])  # 0: a plain move
            by_size = np.argsort(worth, kind="stable")
            # Moving d bytes net leaves a gap of |gap - 2 d|; for each slot given, the best partner is by bisection.
            wish = sizes[give] - gap / 2
            at = np.searchsorted(worth[by_size], wish)
            best = None
            for near in (at - 1, at):
                k = np.clip(near, 0, len(worth) - 1)
                left = np.abs(gap - 2 * (sizes[give] - worth[by_size][k]))
                i = int(left.argmin())
                if best is None or left[i] < best[0]:
                    best = (left[i], give[i], by_size[k[i]])
            if best[0] < gap:
                _, out, back = best
                shard_of[out] = lo
                net = sizes[out]
                if back:
                    shard_of[take[back - 1]] = hi
                    net = net - sizes[take[back - 1]]
                load[hi] -= net
                load[lo] += net
                edits += 1
                break
        else:
            break
    return shard_of


def map_rows(version: int, shard_of: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows of the slot map; ``first``: records of the same shard in lower slots."""
    first = np.zeros(len(shard_of), np.int64)
    for s in np.unique(shard_of):
        own = np.flatnonzero(shard_of == s)
        first[own] = np.cumsum(counts[own]) - counts[own]
    return [
        (version, i, int(s), int(b), int(n), int(f))
        for i, (s, b, n, f) in enumerate(zip(shard_of, sizes, counts, first, strict=True))
    ]


def shard(
    records: DataFrame,
    shards: int,
    size_col: str,
    key_cols: list[str],
    slots: int = SLOTS,
    previous: np.ndarray | None = None,
    version: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Records with vslot, shard and slot (the place in the shard), and the slot map used.

    ``previous`` is the map to edit (the round-robin one by default). The slot map is collected for editing: it has
    ``slots`` rows at any input size.
    """
    spark = records.sparkSession
    placed = records.withColumn("vslot", slot_of(*key_cols, slots=slots))
    sizes, counts = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    # The second hash cuts a slot for numbering; its counts give each cut's first number.
    cut = F.pmod(F.xxhash64(F.struct(*key_cols), F.lit(1)), F.lit(8)).cast("int")
    placed = placed.withColumn("vcut", cut)
    each = placed.groupBy("vslot", "vcut").agg(F.sum(size_col).alias("bytes"), F.count("*").alias("n")).collect()
    in_cut = np.zeros((slots, 8), np.int64)
    for r in each:
        sizes[r["vslot"]] += r["bytes"] or 0
        counts[r["vslot"]] += r["n"]
        in_cut[r["vslot"], r["vcut"]] = r["n"]
    shard_of = rebalance(first_map(shards, slots) if previous is None else previous, sizes, shards)
    rows = map_rows(version, shard_of, sizes, counts)
    slot_map = spark.createDataFrame(rows, MAP)
    ahead = in_cut.cumsum(axis=1) - in_cut
    cuts = [(r[1], c, r[2], int(r[5] + ahead[r[1], c])) for r in rows for c in range(8) if in_cut[r[1], c]]
    places = spark.createDataFrame(cuts, "vslot int, vcut int, shard int, base long")
    number = F.row_number().over(Window.partitionBy("vslot", "vcut").orderBy(*key_cols, size_col))
    numbered = placed.withColumn("number", number)
    # At most 8 rows for each slot: a fixed bound.
    joined = numbered.drop("shard", "slot").join(F.broadcast(places), ["vslot", "vcut"])
    out = joined.withColumn("slot", F.col("base") + F.col("number") - 1).drop("vcut", "base", "number")
    return out, slot_map


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the stored slot map, by default the newest; None without one."""
    versions = [int(v) for v in tables.partition_values(spark, path, "version")]
    if not versions:
        return None
    return spark.read.schema(MAP).parquet(f"{path}/version={max(versions) if version is None else version}")


def shard_by_stored_map(
    records: DataFrame, shards: int, size_col: str, key_cols: list[str], path: str, slots: int = SLOTS
) -> DataFrame:
    """The records placed by the newest map under ``path``, edited for their sizes; the edit is stored as the next version.

    A map is one small table a version and is never written over. Records are placed by what has been stored.
    """
    spark = records.sparkSession
    newest = read_map(spark, path)
    previous, version = None, 0
    if newest is not None:
        rows = newest.select("version", "vslot", "shard").collect()  # ``slots`` rows
        version = rows[0]["version"]
        previous = np.zeros(slots, np.int64)
        for r in rows:
            previous[r["vslot"]] = r["shard"]
    placed, edited = shard(records, shards, size_col, key_cols, slots, previous, version + 1)
    edited.coalesce(1).write.parquet(f"{path}/version={version + 1}")
    return placed
