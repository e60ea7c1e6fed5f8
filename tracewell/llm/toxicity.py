"""Toxicity by a linear model on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram (hashed to one of ``BINS`` bins) anywhere in the whole lower-cased text. Class counts of
all bins come from every labelled row that may be learnt from, summed in Spark. A bin's ratio is
log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)) with the documents of each class that have it. The bins whose ratio is
largest against its standard error (``FEATURES`` of them) are kept; a logistic regression on their scaled presence is
fitted to about ``FIT_ROWS`` labelled rows at most, drawn by hash of their id. The score of a text is the sum of its bins'
weights through the logistic function.

Defined results: null and empty texts score as texts without any n-gram do; without labelled rows of both classes, or without
any, the score is the smoothed share of label 1; labels that are null or neither 0 nor 1 are not learnt from; repeated rows
score the same; extra columns do not take part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrays import pack, unpack
from tracewell.llm.batches import for_texts
from tracewell.llm.sampling import hash_sample
from tracewell.session import materialise

ORDERS = (4, 6, 8)
BINS = 1 << 20
FEATURES = 1 << 10
FIT_ROWS = 12_000
#: Characters worked on at once; longer texts go piece by piece, pieces overlapping by the longest n-gram.
PIECE = 1 << 20
_CHUNK = 1 << 14


class Grams:
    """Bins present in a text, each once."""

    def __init__(self):
        self.last = np.zeros(BINS, np.int32)

    def _bins(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        found = []
        rolling = np.zeros(len(code), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(code) < n:
                break
            # Each order extends the one before it by the next character.
            rolling = rolling[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                mixed = (rolling + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                found.append((mixed >> np.uint64(44)).astype(np.int32))
        return np.concatenate(found) if found else np.empty(0, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        text = f" {text.lower()} "
        step = PIECE - max(ORDERS) + 1
        every = [self._once(self._bins(text[i : i + PIECE])) for i in range(0, max(1, len(text) - max(ORDERS) + 1), step)]
        return every[0] if len(every) == 1 else np.unique(np.concatenate(every))

    def _once(self, bins: np.ndarray) -> np.ndarray:
        """Without repeats and without sorting: the last place written for a bin keeps it."""
        places = np.arange(len(bins), dtype=np.int32)
        self.last[bins] = places
        return bins[self.last[bins] == places]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of every bin
    bias: float


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class by bin, in chunks of bins."""
    grams, counts, rows = Grams(), np.zeros((2, BINS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for label, body in zip(batch.column("label").to_pylist(), batch.column("body"), strict=True):
            counts[label, grams(body.as_py())] += 1
            rows[label] += 1
    if rows.any():
        chunks = range(BINS // _CHUNK)
        parts = [pack(counts[:, c * _CHUNK : (c + 1) * _CHUNK].ravel()) for c in chunks]
        n = len(parts)
        columns = [pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())]
        columns += [pa.array([int(rows[k])] * n, pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "counts", "n0", "n1"])


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(2 * _CHUNK, np.int64)
    for x in group["counts"]:
        total += unpack(x, np.int32)
    return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "counts": [pack(total)], "n0": [group["n0"].sum()], "n1": [group["n1"].sum()]})


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(2, BINS) documents of each class that have the bin, and the documents of each class; of fixed size."""
    parts = rows.select("label", "body").mapInArrow(_count, "chunk int, counts binary, n0 long, n1 long")
    summed = parts.groupBy("chunk").applyInPandas(_sum, "chunk int, counts binary, n0 long, n1 long").collect()
    counts, total = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
    for r in summed:
        counts[:, r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = unpack(r["counts"], np.int64).reshape(2, -1)
        total[:] = r["n0"], r["n1"]
    return counts, total


def _present(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        place = np.full(BINS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            labels, rows = batch.column("label"), []
            for body in batch.column("body"):
                own = place[grams(body.as_py())]
                rows.append(np.sort(own[own >= 0]).tobytes())
            yield pa.RecordBatch.from_arrays([labels, pa.array(rows, pa.binary())], ["label", "present"])

    return run


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, l2: float = 1.0, steps: int = 300) -> Model:
    """``rows``: doc_id, body, label. What comes to the driver is bounded by ``BINS``, ``FEATURES`` and ``fit_rows``."""
    rows = materialise(for_texts(rows), "toxicity-rows")
    counts, total = class_counts(rows)
    prior = float(np.log((total[1] + 1) / (total[0] + 1)))
    if not total.all():
        return Model(np.zeros(BINS, np.float32), prior)
    with_it = counts + 1.0
    ratio = np.log(with_it[1] / (total[1] + 2)) - np.log(with_it[0] / (total[0] + 2))
    error = np.sqrt(1 / with_it[1] + 1 / with_it[0])
    strength = np.where(counts.sum(0) >= 2, np.abs(ratio) / error, 0)
    order = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = np.sort(order[strength[order] > 0])
    if not len(chosen):
        return Model(np.zeros(BINS, np.float32), prior)
    sample = hash_sample(rows, int(total.sum()), fit_rows, "doc_id")
    got = sample.select("label", "body").mapInArrow(_present(chosen), "label int, present binary").toArrow()
    y = got["label"].to_numpy().astype(float)
    lists = [np.frombuffer(x, np.int32) for x in got["present"].to_pylist()]
    w, b = _logistic(lists, y, ratio[chosen], l2, steps)
    weights = np.zeros(BINS, np.float32)
    weights[chosen] = w * ratio[chosen]
    return Model(weights, b)


def _logistic(lists: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent; a column's step is tempered by how often its feature occurs."""
    n, d = len(y), len(scale)
    column = np.concatenate(lists)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    value = scale[column]
    # Row sums bound the curvature: a diagonal bound that needs no line search.
    reach = np.bincount(row, np.abs(value), n)
    bound = 0.25 * np.bincount(column, np.abs(value) * reach[row], d) + l2
    bound_b = 0.25 * n
    w, b = np.zeros(d), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(row, value * vw[column], n) + vb
        g = 1 / (1 + np.exp(-z)) - y
        nw = vw - (np.bincount(column, value * g[row], d) + l2 * vw) / bound
        nb = vb - g.sum() / bound_b
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        weights, bias = model.value.weights, model.value.bias
        for batch in batches:
            z = np.array([weights[grams(x.as_py())].sum(dtype=np.float64) for x in batch.column("body")]) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row. The broadcast weights have ``BINS`` entries, whatever the data."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = for_texts(docs).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(shared), f"doc_id {kind}, score double")
