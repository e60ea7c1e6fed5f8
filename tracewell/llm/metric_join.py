"""Near-duplicate vectors by an exact metric range join.

Unit vectors with a cosine of at least ``c`` are at most r = sqrt(2 - 2 c) apart. Pivots (a bounded sample of the vectors)
cut the space into cells: a vector belongs to the cell of its nearest pivot. If x in cell i and y in cell j are within r,
the triangle inequality gives d(x, pj) <= d(x, pi) + 2 r, and the distance of x to the plane between both pivots is at most r;
a vector is copied to each later cell where both hold, and to no other. Cells then join independently, cut by label, and
large ones in pairs of blocks of bounded size. Equal vectors are one class with a count before all that. Pairs are not
written: a block gives each vector its number of links and the least vector of its component within the block.

Defined results: see ``vectors.usable`` for rows that link with nothing, null labels likewise; each row is a vector of its
own, repeated ids included; extra columns do not take part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.graph import components
from tracewell.llm.sampling import hash_sample
from tracewell.llm.vectors import dots, matrix, usable
from tracewell.session import materialise

#: Vectors meant for a pivot; bounds of the number of pivots (which is broadcast). Rows of a block.
PIVOT_ROWS = 2000
MIN_PIVOTS, MAX_PIVOTS = 8, 1024
BLOCK = 2048


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _cells(pivots: np.ndarray, r: float):
    """Each class in its own cell, and in each later cell that it may have a partner in."""
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(matrix(batch.column("vec"), pivots.shape[1]))
            square = np.maximum(2 - 2 * x @ pivots.T, 0)
            far = np.sqrt(square)
            own = far.argmin(axis=1)
            row = np.arange(len(x))
            slack = 1e-7
            triangle = far <= far[row, own][:, None] + 2 * r + slack
            plane = (square - square[row, own][:, None]) / (2 * between[own]) <= r + slack
            reach = triangle & plane & (np.arange(len(pivots)) > own[:, None])
            out_row, out_cell = np.nonzero(reach)
            rows, cells = np.concatenate([row, out_row]), np.concatenate([own, out_cell])
            inner = np.repeat([True, False], [len(row), len(out_row)])
            taken = batch.select(["label", "rep", "n", "vec"]).take(pa.array(rows))
            taken = taken.append_column("cell", pa.array(cells, pa.int32()))
            yield taken.append_column("inner", pa.array(inner))

    return run


def _links(group: pd.DataFrame, c: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, links and least linked rep within the block, of vectors with a link."""
    left = group[group["side"] == 0]
    right = group[group["side"] == 1]
    a_raw = np.array(left["vec"].tolist())
    alone = not len(right)
    a_rep, a_n = left["rep"].to_numpy(), left["n"].to_numpy()
    if alone:
        b_raw, b_rep, b_n = a_raw, a_rep, a_n
    elif not len(left):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    else:
        b_raw, b_rep, b_n = np.array(right["vec"].tolist()), right["rep"].to_numpy(), right["n"].to_numpy()
    cosine = _units(a_raw) @ _units(b_raw).T
    linked = cosine >= c
    i, j = np.nonzero(np.abs(cosine - c) < 1e-9)
    if len(i):  # decided on the vectors as given
        x, y = a_raw[i], b_raw[j]
        linked[i, j] = dots(x, y) / (np.sqrt(dots(x, x)) * np.sqrt(dots(y, y))) >= c
    if alone:
        np.fill_diagonal(linked, False)
    links_a, links_b = linked @ b_n, linked.T @ a_n
    rows, columns = np.flatnonzero(links_a), np.flatnonzero(links_b)
    linked = linked[np.ix_(rows, columns)]
    rep_a, rep_b = a_rep[rows], b_rep[columns]
    root_a, root_b = rep_a.copy(), rep_b.copy()
    if len(rows):
        top = np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(root_a, np.where(linked, root_b[None, :], top).min(axis=1))
            new_b = np.minimum(root_b, np.where(linked, new_a[:, None], top).min(axis=0))
            if alone:
                new_a = new_b = np.minimum(new_a, new_b)
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
    if alone:
        return rep_a, links_a[rows], root_a
    return (np.concatenate([rep_a, rep_b]), np.concatenate([links_a[rows], links_b[columns]]),
            np.concatenate([root_a, root_b]))


def _block_links(c: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rep, links, root = _links(group, c)
        return pd.DataFrame({"rep": rep, "links": links, "root": root})

    return run


def near_vectors(
    rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = rows.sparkSession
    labelled = rows.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).cast("string").alias("label")
    )
    good, d = usable(labelled, "vec_id", "embedding", "label")
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"))
    if not d:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    key = F.sha2(F.concat_ws(",", "label", F.col("vec").cast("array<string>")), 256)
    members = materialise(good.withColumn("key", key), "metric-rows")
    # Copies collapse by partial aggregation before they are shuffled.
    classes = members.groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    classes = materialise(classes, "metric-classes")
    n = classes.count()
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, n // PIVOT_ROWS))
    drawn = hash_sample(classes, n, wanted, "key").orderBy("key").select("vec").toArrow()
    if not drawn.num_rows:
        drawn = classes.select("vec").limit(1).toArrow()
    pivots = np.unique(_units(matrix(drawn["vec"].combine_chunks(), d)), axis=0)
    r = float(np.sqrt(2 - 2 * cosine))
    kind = "label string, rep long, n long, vec array<double>, cell int, inner boolean"
    spread = classes.select("label", "rep", "n", "vec").mapInArrow(_cells(pivots, r), kind)
    spread = materialise(spread, "metric-cells")
    sizes = spread.groupBy("label", "cell").agg(
        F.ceil(F.sum(F.col("inner").cast("int")) / BLOCK).cast("int").alias("ins"),
        F.ceil(F.sum((~F.col("inner")).cast("int")) / BLOCK).cast("int").alias("outs"),
    )
    placed = spread.join(sizes, ["label", "cell"]).where("ins > 0").withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))).cast("int")
    )

    def meets(outer, a, b, side):
        return F.struct(F.lit(outer).alias("outer"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    own, ins, outs = F.col("own"), F.col("ins"), F.col("outs")
    # A block of the cell meets itself, each later block, and each block of copies from other cells.
    inner_meets = F.concat(
        F.transform(F.filter(upto(ins), lambda b: b >= own), lambda b: meets(False, own, b, 0)),
        F.transform(F.filter(upto(ins), lambda a: a < own), lambda a: meets(False, a, own, 1)),
        F.transform(upto(outs), lambda a: meets(True, a, own, 1)),
    )
    outer_meets = F.transform(upto(ins), lambda b: meets(True, own, b, 0))
    meeting = placed.withColumn("m", F.explode(F.when(F.col("inner"), inner_meets).otherwise(outer_meets)))
    task = ["label", "cell", "outer", "a", "b"]
    met = meeting.select("label", "cell", "m.*", "rep", "n", "vec")
    # Blocks of one cell that meet no second block still join themselves; copies without own rows were left out above.
    links = met.groupBy(*task).applyInPandas(_block_links(cosine), "rep long, links long, root long")
    links = materialise(links, "metric-links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("key", "rep", "n").join(counts, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    linked = members.select("vec_id", "key").join(of_class, "key").select("vec_id", "n_links", "root")
    alone = _others(rows, id_col, vec_col, label_col, d)
    result = linked.unionByName(alone)
    return result.select(
        "vec_id", "n_links", F.col("root").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("root")).alias("kept")
    )


def _others(rows: DataFrame, id_col: str, vec_col: str, label_col: str, d: int) -> DataFrame:
    """Rows that link with nothing."""
    vec = F.col(vec_col).cast("array<double>")
    good = (
        F.col(id_col).isNotNull()
        & F.col(label_col).isNotNull()
        & (F.size(vec) == d)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vec, lambda x: x != 0)
    )
    left = rows.where(~F.coalesce(good, F.lit(False)))
    return left.select(
        F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("root")
    )
