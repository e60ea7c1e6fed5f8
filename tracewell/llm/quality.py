"""Quality by a regularised quadratic discriminant on document statistics.

Each whole text gives a short vector of statistics, transformed (logarithms of counts, log-odds of shares) and standardised by
the means and deviations of the labelled rows. Sums and cross products of each class are taken over every labelled row that may
be learnt from, summed in Spark. A class covariance is shrunk towards the pooled one (``TO_POOLED``) and that towards a multiple
of the identity (``TO_SPHERE``). Its Cholesky factor is kept in the model; the score is the logistic of the difference
of log densities (Mahalanobis distance by one triangular solve) plus the log of the class odds.

Defined results: null and empty texts have the statistics of no words; without two labelled rows of each class the score is the
smoothed share of label 1; labels that are null or neither 0 nor 1 are not learnt from; repeated rows score the
same; extra columns do not take part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewell.llm.batches import for_texts, giving_back

TO_POOLED = 0.1
TO_SPHERE = 0.02

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?'\"-()"]] = True
_SENTENCE = re.compile(rb"[.!?](?=\s|$)")

NAMES = (
    "words", "word_length", "alpha", "upper", "digit", "space", "stop", "symbol", "distinct", "short", "lines_per_word",
    "line_repeats", "sentences_per_word", "bare_words", "long_words",
)


def _odds(part: float, whole: float) -> float:
    """Log-odds of a share, smoothed by a whole that is never empty."""
    return float(np.log((part + 0.1) / (whole - part + 0.1)))


def statistics(body: bytes) -> list[float]:
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    n = len(body)
    alpha, upper, digit, space, stop = (int(counts[x].sum()) for x in (_ALPHA, _UPPER, _DIGIT, _SPACE, _STOP))
    words = body.split()
    w = len(words)
    lines = [x for x in body.split(b"\n") if x.strip()]
    short = sum(len(x) <= 3 for x in words)
    long = sum(len(x) >= 12 for x in words)
    bare = sum(not x.isalnum() and not x[:-1].isalnum() and x.isascii() for x in words)
    return [
        float(np.log1p(w)),
        float(np.log((n - space + 1) / (w + 1))),
        _odds(alpha, n),
        _odds(upper, n),
        _odds(digit, n),
        _odds(space, n),
        _odds(stop, n),
        _odds(n - alpha - digit - space - stop, n),
        _odds(len(set(words)), w),
        _odds(short, w),
        float(np.log((len(lines) + 1) / (w + 1))),
        _odds(len(lines) - len(set(lines)), len(lines)),
        float(np.log((len(_SENTENCE.findall(body)) + 0.5) / (w + 1))),
        _odds(bare, w),
        _odds(long, w),
    ]


@dataclass(frozen=True)
class Model:
    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray | None  # (2, d)
    factors: np.ndarray | None  # (2, d, d), inverse lower Cholesky factors
    log_dets: np.ndarray | None
    log_odds: float

    def log_odds_of(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.log_odds)
        z = (x - self.shift) / self.scale
        density = []
        for k in (0, 1):
            solved = (z - self.means[k]) @ self.factors[k].T
            density.append(-0.5 * (solved**2).sum(axis=1) - 0.5 * self.log_dets[k])
        return density[1] - density[0] + self.log_odds


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([statistics(b.as_py()) for b in batch.column("body")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), x], ["key", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (the id), x (the statistics of the text) of every row: what is shuffled and kept instead of texts."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = for_texts(docs).select(F.col(id_col).alias("key"), body.alias("body"))
    return rows.mapInArrow(giving_back(_featured), f"key {rows.schema['key'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES) + 1
    total = np.zeros((2, d, d))
    for batch in batches:
        labels, x = batch.column("label").to_numpy(), _matrix(batch.column("x"))
        x = np.column_stack([np.ones(len(x)), x])
        for k in (0, 1):
            own = x[labels == k]
            total[k] += own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array([total[k].ravel().tolist()]) for k in (0, 1)], ["m0", "m1"])


def fit(rows: DataFrame, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Model:
    """``rows``: label, x. One matrix of moments for each class comes to the driver."""
    d = len(NAMES) + 1
    parts = rows.select("label", "x").mapInArrow(_moments, "m0 array<double>, m1 array<double>")
    each = parts.select(F.posexplode(F.concat("m0", "m1")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * d * d)
    for r in each:
        flat[r["i"]] = r["v"]
    m = flat.reshape(2, d, d)
    n = m[:, 0, 0]
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    both = m.sum(0)
    if n.min() < 2:
        return Model(np.zeros(d - 1), np.ones(d - 1), None, None, None, log_odds)
    shift = both[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n.sum() - shift**2, 1e-6))
    raw = m[:, 0, 1:] / n[:, None]
    means = (raw - shift) / scale
    covariances = [(m[k, 1:, 1:] / n[k] - np.outer(raw[k], raw[k])) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    factors, log_dets = [], []
    for k in (0, 1):
        shrunk = (1 - to_pooled) * covariances[k] + to_pooled * pooled
        sphere = np.trace(shrunk) / (d - 1) + 1e-6
        shrunk = (1 - to_sphere) * shrunk + to_sphere * sphere * np.eye(d - 1)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Model(shift, scale, means, np.array(factors), np.array(log_dets), log_odds)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(model.log_odds_of(_matrix(batch.column("x"))), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score, pa.float64())], ["key", "score"])

    return run


def score(featured: DataFrame, model: Model) -> DataFrame:
    """key, score (0 to 1) of every row of ``features``."""
    kind = featured.schema["key"].dataType.simpleString()
    return featured.select("key", "x").mapInArrow(_scorer(model), f"key {kind}, score double")


def _accepted(model, least: float, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = float(np.log(least / (1 - least)))
        for batch in batches:
            texts = batch.column("row").field(place)
            x = np.array([statistics((t.as_py() or "").encode()) for t in texts]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.log_odds_of(x) >= bound))

    return run


def keep(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The input rows with a score of at least ``least``, all columns as they are. Each text goes through Arrow once."""
    rows = for_texts(docs).select(F.struct("*").alias("row"))
    kept = rows.mapInArrow(giving_back(_accepted(model, least, docs.columns.index(text_col))), StructType([StructField("row", docs.schema)]))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
