"""Ranked lexical search by range-maximum tables and best-first document intervals.

Documents are read once and leave their length and the counts of the terms that any item asks for. Sums over these give N, L and
the document frequencies. Blocks of documents, ordered by id, then get one posting list a term, each with a sparse table that answers the
maximum impact in any range of the list with two look-ups. For each item a priority queue holds intervals of documents by the sum of
their terms' maxima, a bound on every score inside. The highest intervals are opened first: the document where one of the maxima
stands is scored exactly, and the interval is split there. An interval of few postings is summed outright. The search of a block ends
when no interval can reach the item's tenth score; that score is kept from block to block of a task. The best of all tasks are ranked.

Bounds: a block holds ``POSTINGS`` postings, or one document. Items are searched in groups whose texts have about ``ITEM_BYTES`` bytes
together; what is broadcast (terms and items of a group) is bounded by that, and more items mean more passes. A pass sends at
most ``k`` rows for each item and task.

Defined results: null and empty texts have no terms and count nowhere; an item without terms has no rows; rows repeated under one
document id are documents of their own; documents without an id come after the others of their score; rows of one item id are one
item; a null item id is an id; extra columns do not take part; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.batches import for_texts
from tracewell.session import materialise

POSTINGS = 1 << 20
ITEM_BYTES = 16_000_000
#: Intervals opened together at first (doubled each time), and at most; postings of an interval that is summed outright.
TOGETHER, MOST_TOGETHER = 8, 512
SMALL = 256
#: Fixed values of the score.
SCALE, TF_SHARE, BASE, LENGTH_SHARE = 1_000_000_000, 1000, 10, 90
_NO_ID = 2**63 - 1
#: Separators become spaces, capital letters small; bytes above 127 belong to terms.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, only A to Z in lower case."""
    return text.encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Items:
    """A group of items: their ids, their distinct terms by number, and each item's term numbers."""

    ids: pa.Array
    numbers: dict[bytes, int]
    asked: list[np.ndarray]


def _items(rows: pa.Table) -> Items:
    numbers: dict[bytes, int] = {}
    asked = []
    for texts in rows["texts"].to_pylist():
        own = {t for text in texts for t in terms(text)}
        asked.append(np.array(sorted(numbers.setdefault(t, len(numbers)) for t in own), np.int64))
    return Items(rows["item_id"].combine_chunks(), numbers, asked)


def _counted(items):
    """doc_id, n, and the counts of asked terms, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = items.value.numbers
        for batch in batches:
            n, own, counts = [], [], []
            for text in batch.column("body"):
                found = terms(text.as_py())
                asked = np.fromiter((numbers[t] for t in found if t in numbers), np.int32)
                which, times = np.unique(asked, return_counts=True)
                n.append(len(found))
                own.append(which.astype("<i4").tobytes())
                counts.append(times.astype("<i4").tobytes())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return run


def _frequencies(size: int):
    """One row for each term of a task, and one (term -1) with its documents and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs += int((n > 0).sum())
            length += int(n.sum())
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        some = np.flatnonzero(df)
        columns = [pa.array(np.append(some, -1)), pa.array(np.append(df[some], docs)), pa.array(np.append(np.zeros(len(some), np.int64), length))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "df", "length"])

    return run


class RangeMax:
    """Where the largest of ``values`` in a range stands: tables of the places of maxima of 2**k neighbours."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.tables = [np.arange(len(values), dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            low, high = self.tables[-1][: len(values) - 2 * step + 1], self.tables[-1][step : len(values) - step + 1]
            self.tables.append(np.where(values[low] >= values[high], low, high))
            step *= 2

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the maximum in [left, right); -1 and 0 where that is empty."""
        width = right - left
        place = np.full(left.shape, -1, np.int64)
        level = np.frexp(np.maximum(width, 1).astype(float))[1] - 1
        for k in np.unique(level[width > 0]).tolist():
            own = (level == k) & (width > 0)
            a, b = self.tables[k][left[own]], self.tables[k][right[own] - (1 << k)]
            place[own] = np.where(self.values[a] >= self.values[b], a, b)
        return place, np.where(place >= 0, self.values[place], 0)


class Best:
    """The ``k`` best (score, id) of an item; equal scores by lower id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def reachable(self, bound: int, least_id: int) -> bool:
        """Whether a document with a score up to ``bound`` and an id from ``least_id`` on can be among the best."""
        return bound > 0 and (len(self.heap) < self.k or (bound, -least_id) > self.heap[0])

    def offer(self, score: int, doc_id: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc_id))
        elif (score, -doc_id) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc_id))


class Block:
    """Posting lists of some documents (ids ascending) in one array ordered by (term, document), with their range maxima."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.n = ids, len(ids)
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.key = term[order].astype(np.int64) * (self.n + 1) + self.doc
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.maxima = RangeMax(self.impact, longest)

    def search(self, asked: np.ndarray, best: Best) -> None:
        first = asked * (self.n + 1)
        left, right = np.searchsorted(self.key, first), np.searchsorted(self.key, first + self.n)
        held = right > left
        first, left, right = first[held], left[held], right[held]
        if not len(first):
            return
        # An interval: low and high document, its part of each posting list, where the maxima of the parts stand.
        queue: list[tuple] = []
        serial = 0

        def add(low, high, lefts, rights) -> None:
            nonlocal serial
            places, values = self.maxima(lefts, rights)
            sums = values.sum(axis=1)
            top = places[np.arange(len(places)), values.argmax(axis=1)]
            for i in np.flatnonzero(sums > 0).tolist():
                if best.reachable(int(sums[i]), int(self.ids[low[i]])):
                    serial += 1
                    heapq.heappush(queue, (-int(sums[i]), serial, int(low[i]), int(high[i]), lefts[i], rights[i], int(top[i])))

        add(np.array([0]), np.array([self.n]), left[None, :], right[None, :])
        together = TOGETHER
        while queue:
            split, summed = [], []
            while queue and len(split) + len(summed) < together:
                bound, _, low, high, lefts, rights, top = heapq.heappop(queue)
                if not best.reachable(-bound, int(self.ids[low])):
                    continue
                part = (low, high, lefts, rights, top)
                (summed if int((rights - lefts).sum()) <= SMALL else split).append(part)
            together = min(2 * together, MOST_TOGETHER)
            if summed:
                self._sum(np.concatenate([p[2] for p in summed]), np.concatenate([p[3] for p in summed]), best)
            if split:
                low, high = np.array([p[0] for p in split]), np.array([p[1] for p in split])
                lefts, rights = np.array([p[2] for p in split]), np.array([p[3] for p in split])
                at = self.doc[np.array([p[4] for p in split])].astype(np.int64)
                key = first[None, :] + at[:, None]
                place = np.searchsorted(self.key, key)
                here = (place < rights) & (self.key[np.minimum(place, len(self.key) - 1)] == key)
                scores = np.where(here, self.impact[np.minimum(place, len(self.key) - 1)], 0).sum(axis=1)
                for d, score in zip(at.tolist(), scores.tolist(), strict=True):
                    best.offer(score, int(self.ids[d]))
                place = np.clip(place, lefts, rights)
                add(
                    np.concatenate([low, np.minimum(at + 1, self.n - 1)]),
                    np.concatenate([at, high]),
                    np.concatenate([lefts, place + here]),
                    np.concatenate([place, rights]),
                )

    def _sum(self, left: np.ndarray, right: np.ndarray, best: Best) -> None:
        """Scores of all documents with postings in the given parts."""
        width = right - left
        place = np.repeat(left - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(int(width.sum()))
        docs, number = np.unique(self.doc[place], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, number, self.impact[place])
        order = np.argsort(-scores, kind="stable")[: 4 * best.k]
        if len(order) < len(docs):  # all that tie with the last one taken
            order = np.flatnonzero(scores >= scores[order[-1]])
        for score, d in zip(scores[order].tolist(), docs[order].tolist(), strict=True):
            if best.reachable(score, int(self.ids[d])):
                best.offer(score, int(self.ids[d]))


def _searched(items, weights: np.ndarray, docs: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value.asked
        best = [Best(k) for _ in asked]
        held: list[tuple[int, int, bytes, bytes]] = []

        def search(rows: list[tuple[int, int, bytes, bytes]]) -> None:
            rows.sort(key=lambda r: r[0])
            ids, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            term = np.frombuffer(b"".join(r[2] for r in rows), "<i4")
            times = np.frombuffer(b"".join(r[3] for r in rows), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 4 for r in rows])
            m = BASE + LENGTH_SHARE * n * docs // length
            impact = weights[term] * (SCALE * times // (TF_SHARE * times + 8 * m[doc]))
            some = impact > 0
            block = Block(ids, doc[some], term[some], impact[some])
            for own, top in zip(asked, best, strict=True):
                block.search(own, top)

        size = 0
        for batch in batches:
            ids = [_NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            for row in zip(ids, batch.column("n").to_pylist(), batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                postings = len(row[2]) // 4
                if held and size + postings > POSTINGS:
                    search(held)
                    held, size = [], 0
                if postings:
                    held.append(row)
                    size += postings
        if held:
            search(held)
        item = np.repeat(np.arange(len(best)), [len(b.heap) for b in best])
        found = [(-d, s) for b in best for s, d in b.heap]
        ids = pa.array([None if d == _NO_ID else d for d, _ in found], pa.int64())
        columns = [items.value.ids.take(pa.array(item)), ids, pa.array([s for _, s in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = asked.groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    size = asked.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t)))).first()[0] or 0
    groups = max(1, -(-size // item_bytes))
    kind = asked.schema["item_id"].dataType.simpleString()
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = for_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    found = None
    for group in range(groups):
        # About ``item_bytes`` bytes of items.
        own = _items(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).toArrow())
        shared = spark.sparkContext.broadcast(own)
        counted = rows.mapInArrow(_counted(shared), "doc_id long, n long, terms binary, counts binary")
        counted = materialise(counted, "lexical-docs")
        sums = counted.mapInArrow(_frequencies(len(own.numbers)), "term long, df long, length long")
        sums = sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).toArrow()
        by_term = dict(zip(sums["term"].to_pylist(), zip(sums["df"].to_pylist(), sums["length"].to_pylist(), strict=True), strict=True))
        n, length = by_term.pop(-1, (0, 0))
        weights = np.zeros(len(own.numbers), np.int64)
        for term, (df, _) in by_term.items():
            weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        best = counted.mapInArrow(_searched(shared, weights, n, max(1, length), k), f"item_id {kind}, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
