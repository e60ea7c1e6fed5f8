"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources' weights share a number of words; no target is over a cap, what a capped source leaves is shared by
the others. A source then needs ``rate = target / size`` copies of its words on average: ``floor(rate)`` whole copies
of each document are certain, the rest is sampled. Documents are ranked by random odds over inclusion odds,
``u / (1 - u) * (1 - p) / p``, and taken in that order until the words still wanted are reached (fixed size in
words, within half a document). The inclusion chance ``p`` differs between sources, and inside a source where a
``tilt`` column is given. At last one document of each source may be added or dropped, where that brings the source
closer to its target.

``u`` comes from MD5 of seed and id, so that reruns agree and SQL can repeat it.

Order inside a source is by a key cut into ``CELLS`` cells of equal chance. Sums by cell give the cell in which the wanted
words run out; only that cell is ordered row by row, so a source with a third of all rows is no single task.

Defined results: a null text has no words and is never repeated for words; a null source is a source, ordered last;
repeated rows are rows of their own (equal rows are ordered next to each other); extra columns do not take part;
an empty table gives an empty result; where all sizes are 0, nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import materialise

CELLS = 4096
#: Fixed weights, repeated along the sources in code point order.
WEIGHTS = (3, 1, 2)


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: str | Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def targets(
    sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """source, source_size, target for one row ``source, source_size`` of each source.

    Sources are capped in the order of cap over weight: with a level ``v`` the target is min(cap, v * weight), and the
    level that spends everything follows from sums over that order. One row for each source is all that the windows see.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), turn + 1)
    ranked = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    ahead = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(whole) * F.lit(share)
    left = all_words - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    open_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))
    levelled = ranked.withColumn("level", left / open_w)
    # The first source whose cap is not reached by its level fixes the level of all that follow.
    fits = F.col("level") * F.col("w") <= F.col("cap")
    place = F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    level = F.min_by("level", F.when(fits, place)).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return levelled.withColumn("target", target).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    tilt_col: str | None = None,
    seed: int = 17,
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each input row.

    ``tilt_col`` (positive numbers near 1) multiplies the inclusion odds of a document's extra copy.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.col(size_col).cast("long").alias("size"),
        uniform(id_col, seed).alias("u"),
        (F.col(tilt_col).cast("double") if tilt_col else F.lit(1.0)).alias("tilt"),
    )
    # Words are counted once; all that follows reads a few numbers a row.
    rows = materialise(rows, "mix-rows")
    # Salted by the row's own chance: a sum for each source and cell first, then for each source.
    cell_of_u = F.floor(F.col("u") * CELLS).cast("int")
    sizes = (
        rows.groupBy("source", cell_of_u.alias("c")).agg(F.sum("size").alias("size"))
        .groupBy("source").agg(F.sum("size").alias("source_size"))
    )
    goal = targets(sizes, share, cap, weights).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )
    goal = goal.withColumn("whole", F.floor("rate").cast("int"))
    goal = goal.withColumn("part", F.col("rate") - F.col("whole"))
    goal = goal.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    keyed = rows.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    joined = keyed.join(goal.drop("source"), ["key", "none"])
    p = F.least(F.greatest(F.col("part"), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - p) / p) / F.col("tilt")
    # q / (1 + q) keeps the order of q and lies in (0, 1).
    ranked = joined.withColumn("q", odds).withColumn("c", F.floor(F.col("q") / (1 + F.col("q")) * CELLS).cast("int"))
    cells = ranked.groupBy("key", "none", "c").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    along = Window.partitionBy("key", "none").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    state = (
        F.when(F.col("before") + F.col("words") <= F.col("wanted"), 1)
        .when(F.col("before") >= F.col("wanted"), 0).otherwise(2)
    )
    cells = cells.select("key", "none", "c", "before", state.alias("state"))
    at = ranked.join(cells, ["key", "none", "c"])
    at = at.withColumn("can", (F.col("size") > 0) & (F.col("part") > 0))
    settled = at.where("state <> 2").withColumn("extra", F.when(F.col("can"), F.col("state")).otherwise(0))
    run = Window.partitionBy("key", "none").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = at.where("state = 2").withColumn("upto", F.col("before") + F.sum("size").over(run))
    near = F.col("upto") - F.col("size") / 2 <= F.col("wanted")
    edge = edge.withColumn("extra", (F.col("can") & near).cast("int")).drop("upto")
    return _last_step(materialise(settled.unionByName(edge), "mix-chosen"))


def _last_step(chosen: DataFrame) -> DataFrame:
    """Add or drop the one document of each source that brings its words closest to the target."""
    cell = F.floor(F.col("u") * CELLS).cast("int")
    taken = (
        chosen.groupBy("key", "none", cell.alias("c")).agg(
            F.sum(F.col("size") * F.col("extra")).alias("taken"), F.first("wanted").alias("wanted")
        ).groupBy("key", "none").agg(F.sum("taken").alias("taken"), F.first("wanted").alias("wanted"))
    )
    gap = taken.select("key", "none", (F.col("wanted") - F.col("taken")).alias("gap"))
    with_gap = chosen.join(gap, ["key", "none"])
    after = F.abs(F.col("gap") - F.when(F.col("extra") == 1, -F.col("size")).otherwise(F.col("size")))
    offer = F.when(F.col("can") & (after < F.abs("gap")), F.struct(after.alias("after"), "q", "doc_id"))
    best = with_gap.groupBy("key", "none").agg(F.min(offer).alias("best"))
    final = with_gap.join(best, ["key", "none"])
    flip = F.coalesce(offer == F.col("best"), F.lit(False)) & F.col("can")
    # Rows repeated under one id would all be flipped: such a step is left out.
    once = (
        final.where(flip).groupBy("key", "none").agg(F.count("*").alias("rows"))
        .select("key", "none", (F.col("rows") == 1).alias("once"))
    )
    final = final.join(once, ["key", "none"], "left")
    step = flip & F.coalesce("once", F.lit(False))
    copies = F.col("whole") + F.when(step, 1 - F.col("extra")).otherwise(F.col("extra"))
    return final.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def repeat(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The input rows, each as often as the mix takes it, all columns as they are."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), F.struct("*").alias("row")
    )
    mixed = mix(rows.select("id", "source", "size"), id_col="id", **options)
    # Rows repeated under one id are numbered on both sides; their copies are dealt out among them.
    keys = ["id", "source", "size"]
    mine = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    theirs = mixed.select(F.col("doc_id").alias("id"), "source", "size", "copies")
    theirs = theirs.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("copies")))
    theirs = theirs.select(*(F.col(c).alias(f"{c}_2") for c in [*keys, "turn"]), "copies").where("copies > 0")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in [*keys, "turn"]]
    joined = mine.join(theirs, same).select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return joined.select(*(F.col("row")[c].alias(c) for c in docs.columns))
