"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

Largest inner product becomes least distance by one more component, sqrt(M**2 - |x|**2) with M the largest norm. The tree is
fitted to about ``SAMPLE`` rows at most; every row is then filed under the leaf it descends to. A query keeps a priority queue of
nodes by distance to their centre and opens the nearest first, which ranks the leaves for it. How many leaves to visit is
calibrated: for about ``CALIBRATION`` of the queries the true neighbours are found among all rows, and visits widen until the
share of them in visited leaves reaches ``recall``. A query whose leaves hold too few rows for a full result goes on to the next ones.
Queries then meet the rows of their leaves in bundles of neighbouring leaves of
bounded size, however full a leaf is: a query is sent to a bundle once, with the leaves it visits there. The best of each bundle leave
it packed by blocks of queries, and each block keeps the best of all bundles.

Scores are inner products of the original vectors in double precision; ties go to the smaller id.

Defined results: see ``vectors.usable`` for rows that take no part; rows repeated under one id count once in a
result; extra columns do not take part; a query gets all candidates where there are fewer than ``k``; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.arrays import mix64
from tracewell.llm.sampling import hash_sample
from tracewell.llm.vectors import dots, matrix, usable
from tracewell.session import materialise

SAMPLE = 20_000
CALIBRATION = 256
BRANCHES = 8
#: Rows meant for a leaf, and the most leaves (this bounds what is broadcast).
LEAF_ROWS = 256
MAX_LEAVES = 4096
#: Leaves that a small table is split into all the same, of 8 rows at least.
LEAST_LEAVES = 32
#: Rows and queries that meet in one task.
CHUNK = 4096
QUERY_CHUNK = 20_000
#: Found rows of all bundles that are merged in one task.
MERGE_BYTES = 32_000_000


@dataclass
class Tree:
    """Nodes in one array; node 0 is the root. A node without children is a leaf."""

    norm: float
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        lifted, at = self.lift(x), np.zeros(len(x), np.int32)
        centres = np.array(self.centres)
        out = np.full(len(x), -1, np.int32)
        while (todo := np.unique(at[out < 0])).size:
            for node in todo.tolist():
                own = np.flatnonzero((at == node) & (out < 0))
                kids = self.children[node]
                if kids:
                    at[own] = np.array(kids)[_nearest(lifted[own], centres[kids])]
                else:
                    out[own] = self.leaf[node]
        return out

    def order(self, queries: np.ndarray, visits: int, held: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """For each query the leaves that best-bin-first opens, in that order: ``visits``, and more until they hold ``least`` ids."""
        norms = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        scaled = np.column_stack([queries * (self.norm / norms), np.zeros(len(queries))])
        centres = np.array(self.centres)
        far = (centres**2).sum(axis=1) - 2 * scaled @ centres.T
        sizes = [0] * self.leaves if held is None else held.tolist()
        return [self._walk(row, visits, sizes, least) for row in far.tolist()]

    def _walk(self, far: list[float], visits: int, held: list[int], least: int) -> list[int]:
        queue, out, got = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or got < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (far[kid], kid))
            else:
                out.append(self.leaf[node])
                got += held[self.leaf[node]]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def grow(sample: np.ndarray, norm: float, leaves: int, seed: int = 7) -> Tree:
    """A tree with about ``leaves`` leaves over sampled rows."""
    tree, rng = Tree(norm), np.random.default_rng(seed)
    x = tree.lift(sample)
    most = max(1, len(x) // max(1, leaves))

    def add(rows: np.ndarray, centre: np.ndarray) -> int:
        node = len(tree.centres)
        tree.centres.append(centre)
        tree.children.append([])
        tree.leaf.append(-1)
        parts = _split(x[rows], rng) if len(rows) > most and leaves > 1 else None
        if parts is None:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
        else:
            for k in np.unique(parts):
                own = rows[parts == k]
                tree.children[node].append(add(own, x[own].mean(axis=0)))
        return node

    add(np.arange(len(x)), x.mean(axis=0))
    return tree


def _split(x: np.ndarray, rng: np.random.Generator, steps: int = 8) -> np.ndarray | None:
    """Cluster numbers of Lloyd's steps; None where the rows cannot be told apart."""
    different = np.unique(x, axis=0)
    if len(different) < 2:
        return None
    centres = different[rng.choice(len(different), min(BRANCHES, len(different)), replace=False)]
    for _ in range(steps):
        part = _nearest(x, centres)
        centres = np.array([x[part == k].mean(axis=0) if (part == k).any() else centres[k] for k in range(len(centres))])
    part = _nearest(x, centres)
    return part if len(np.unique(part)) > 1 else None


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query number, row number, score) of the ``k`` best rows of each query, its own id left out; ties by id."""
    out_q, out_r, out_s = [], [], []
    for start in range(0, len(queries), 512):
        q = queries[start : start + 512]
        s = q @ rows.T
        s[query_ids[start : start + 512, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        else:
            kth = np.full(len(q), -np.inf)
        # Products of a matrix may differ in the last bits from those of a row: near ties are decided by the latter.
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        near_q, near_r = np.nonzero((s >= (kth - slack)[:, None]) & np.isfinite(s))
        exact = dots(q[near_q], rows[near_r])
        order = np.lexsort((ids[near_r], -exact, near_q))
        near_q, near_r, exact = near_q[order], near_r[order], exact[order]
        first = np.searchsorted(near_q, near_q, side="left")
        keep = np.arange(len(near_q)) - first < k
        out_q.append(near_q[keep] + start)
        out_r.append(near_r[keep])
        out_s.append(exact[keep])
    if not out_q:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def _filed(tree, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.leaf_of(matrix(batch.column("vec"), d))
            yield batch.append_column("leaf", pa.array(leaf, pa.int32()))

    return run


def _truth(ids: np.ndarray, queries: np.ndarray, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = matrix(batch.column("vec"), d), batch.column("vec_id").to_numpy()
            q, r, s = best(queries, ids, x, own, k)
            columns = [pa.array(q, pa.int32()), pa.array(own[r], pa.int64()), pa.array(s), batch.column("leaf").take(pa.array(r))]
            yield pa.RecordBatch.from_arrays(columns, ["q", "vec_id", "score", "leaf"])

    return run


def calibrate(index: DataFrame, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Leaf visits after which the given queries find ``recall`` of their true neighbours, and the recall then."""
    d = queries.shape[1]
    near = index.mapInArrow(_truth(ids, queries, d, k), "q int, vec_id long, score double, leaf int")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    truth = ranked.where(F.col("n") <= k).select("q", "leaf").collect()
    place = np.zeros((len(queries), tree.leaves), np.int64)
    for i, order in enumerate(tree.order(queries, tree.leaves)):
        place[i, order] = np.arange(len(order))
    if not truth:
        return tree.leaves, 1.0
    needed = np.sort([place[r["q"], r["leaf"]] + 1 for r in truth])
    at = min(len(needed), int(np.ceil(recall * len(needed)))) - 1
    visits = int(needed[at])
    return visits, float((needed <= visits).mean())


def _visits(tree, visits: int, d: int, held: np.ndarray, least: int, bundle_of: np.ndarray, shares: int):
    """Queries packed by the bundles of the leaves they visit and by their own share: each once a bundle, with its leaves there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch.column("vec"), d), batch.column("vec_id").to_numpy()
            order = tree.value.order(x, visits, held, least)
            leaf = np.concatenate([np.array(o, np.int32) for o in order]) if order else np.empty(0, np.int32)
            row = np.repeat(np.arange(len(x)), [len(o) for o in order])
            some = bundle_of[leaf] >= 0
            leaf, row = leaf[some], row[some]
            bundle, share = bundle_of[leaf], _share(ids, shares)[row]
            by = np.lexsort((row, share, bundle))
            leaf, row, bundle, share = leaf[by], row[by], bundle[by], share[by]
            new = np.flatnonzero((np.diff(bundle, prepend=-1) != 0) | (np.diff(share, prepend=-1) != 0))
            out: list[tuple] = []
            for first, last in zip(new, np.append(new[1:], len(row)), strict=True):
                own, counts = np.unique(row[first:last], return_counts=True)
                out.append((int(bundle[first]), int(share[first]), len(own), ids[own].tobytes(), x[own].tobytes(),
                            counts.astype(np.int32).tobytes(), leaf[first:last].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _PACKED)

    return run


_PACKED = ["bundle", "share", "n", "ids", "vecs", "counts", "leaves"]


def _share(ids: np.ndarray, shares: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(shares)).astype(np.int64)


def _meet(d: int, k: int, blocks: int):
    """Queries of a bundle with the rows of the leaves they visit; the best of all its leaves for each query, packed by blocks of queries."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(rows) and len(queries):
            query_ids = np.frombuffer(b"".join(queries["ids"]), np.int64)
            vecs = np.frombuffer(b"".join(queries["vecs"]), np.float64).reshape(-1, d)
            asking = np.repeat(np.arange(len(query_ids)), np.frombuffer(b"".join(queries["counts"]), np.int32))
            asked = np.frombuffer(b"".join(queries["leaves"]), np.int32)
            for leaf, own in rows.groupby("leaf"):
                who = asking[asked == leaf]
                x, ids = np.array(own["vec"].tolist()), own["vec_id"].to_numpy()
                q, r, s = best(vecs[who], query_ids[who], x, ids, k)
                found.append((query_ids[who[q]], ids[r], s))
        q, v, s = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < 2 * k  # room for rows repeated under one id
        q, v, s = q[keep], v[keep], s[keep]
        block = _share(q, blocks)
        parts = [(b, *(c[block == b].tobytes() for c in (q, v, s))) for b in np.unique(block).tolist()]
        return pd.DataFrame(parts, columns=["block", "q", "v", "s"])

    return run


def _merge(k: int):
    """The best of all bundles for each query of a block."""

    def run(packed: pd.DataFrame) -> pd.DataFrame:
        q, v = (np.frombuffer(b"".join(packed[c]), np.int64) for c in ("q", "v"))
        s = np.frombuffer(b"".join(packed["s"]), np.float64)
        order = np.lexsort((-s, v, q))
        q, v, s = q[order], v[order], s[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, s = q[once], v[once], s[once]
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left") + 1
        keep = rank <= k
        return pd.DataFrame({"query_id": q[keep], "rank": rank[keep].astype(np.int32), "vec_id": v[keep], "score": s[keep]})

    return run


def bundles(rows: dict[int, int]) -> list[tuple[int, int, int]]:
    """leaf, bundle, chunks: neighbouring leaves together up to ``CHUNK`` rows, fuller ones alone in chunks."""
    out, bundle, held, number = [], [], 0, 0

    def close():
        nonlocal bundle, held, number
        if bundle:
            out.extend((leaf, number, max(1, -(-held // CHUNK))) for leaf in bundle)
            number += 1
        bundle, held = [], 0

    for leaf in sorted(rows):
        if held + rows[leaf] > CHUNK:
            close()
        bundle.append(leaf)
        held += rows[leaf]
    close()
    return out


@dataclass(frozen=True)
class Search:
    result: DataFrame  # query_id, rank, vec_id, score
    leaves: int
    visits: int
    calibrated: float


def search(
    rows: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    recall: float = 0.96,
) -> Search:
    """The ``k`` rows of largest inner product for each row that ``is_query`` (a condition on vec_id) selects."""
    spark = rows.sparkSession
    usable_rows, d = usable(rows, id_col, vec_col)
    if not d:
        return Search(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 0, 0, 1.0)
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, norm = usable_rows.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    drawn = hash_sample(usable_rows, n, SAMPLE, "vec_id").orderBy("vec_id").select("vec").toArrow()
    leaves = min(MAX_LEAVES, max(n // LEAF_ROWS, min(LEAST_LEAVES, n // 8), 1))
    tree = grow(matrix(drawn["vec"].combine_chunks(), d), norm, leaves)
    shared = spark.sparkContext.broadcast(tree)
    index = usable_rows.mapInArrow(_filed(shared, d), "vec_id long, vec array<double>, leaf int")
    index = materialise(index, "ann-index")
    queries = index.where(is_query).select("vec_id", "vec")
    n_queries = queries.count()
    drawn = hash_sample(queries, n_queries, CALIBRATION, "vec_id", seed=1).orderBy("vec_id").toArrow()
    if not drawn.num_rows:
        return Search(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), tree.leaves, 0, 1.0)
    probe = matrix(drawn["vec"].combine_chunks(), d)
    visits, reached = calibrate(index, tree, drawn["vec_id"].to_numpy(), probe, k, recall)
    # One row for each leaf: bounded by the tree. An id in several leaves counts in none, so that no id counts twice.
    held = np.zeros(tree.leaves, np.int64)
    of_id = index.groupBy("vec_id").agg(F.min("leaf").alias("leaf"), F.max("leaf").alias("last")).where("leaf = last")
    for r in of_id.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        held[r["leaf"]] = r["n"]
    # One row for each leaf: bounded by the tree.
    filled = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    placed = bundles(filled)
    bundle_of = np.full(tree.leaves, -1, np.int64)
    for leaf, bundle, _ in placed:
        bundle_of[leaf] = bundle
    shares = max(1, -(-n_queries // QUERY_CHUNK))
    # One more than the result: the query's own id takes no place in it.
    packed = queries.mapInArrow(
        _visits(shared, visits, d, held, k + 1, bundle_of, shares),
        "bundle int, share int, n int, ids binary, vecs binary, counts binary, leaves binary",
    )
    packed = materialise(packed, "ann-visits")
    # One row for each bundle: bounded by the tree.
    asked = {r["bundle"]: r["n"] for r in packed.groupBy("bundle").agg(F.sum("n").alias("n")).collect()}
    # A query is in one share, so all its leaves of a bundle are in one turn.
    turns = [(leaf, bundle, chunks, min(shares, -(-asked[bundle] // QUERY_CHUNK))) for leaf, bundle, chunks in placed if bundle in asked]
    per_bundle = sorted({(bundle, chunks, n) for _, bundle, chunks, n in turns})

    left = index.join(F.broadcast(spark.createDataFrame(turns, "leaf int, bundle int, chunks int, turns int")), "leaf")
    left = left.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = packed.join(F.broadcast(spark.createDataFrame(per_bundle, "bundle int, chunks int, turns int")), "bundle")
    right = right.withColumn("turn", F.pmod("share", "turns")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["bundle", "chunk", "turn"]
    # What a block of queries gets from all bundles fits in MERGE_BYTES.
    meetings = sum(chunks for _, chunks, _ in per_bundle) if len(per_bundle) < visits else visits
    blocks = max(1, -(-n_queries * max(1, meetings) * 48 * k // MERGE_BYTES))
    met = (
        left.select(*key, "leaf", "vec_id", "vec").groupBy(*key)
        .cogroup(right.select(*key, "ids", "vecs", "counts", "leaves").groupBy(*key))
        .applyInPandas(_meet(d, k, blocks), "block long, q binary, v binary, s binary")
    )
    result = met.groupBy("block").applyInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")
    return Search(result, tree.leaves, visits, reached)
