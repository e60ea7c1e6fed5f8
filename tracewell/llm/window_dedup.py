"""Removal of repeated passages by hashes of every fixed-length window of words.

Pass 1 hashes all windows of ``k`` words (Rabin-Karp) and shuffles them by hash range, in blocks: a block holds the
windows of some documents as sorted, packed columns, so a window costs about nine bytes of shuffle instead of thirty.
Inside a block, only the document with the smallest id speaks for a hash; the windows of its other documents are known
to be repeats already. A passage shared by a third of all documents thus reaches its range once for each block.
A range finds, for each hash, the smallest document id of all blocks; windows of larger ids are repeats.
Pass 2 joins the repeats to their documents and merges covering windows into maximal intervals of removed words.
Documents without repeats (a bitmap of fixed size says which) stay where they are read.

Words are maximal runs of other bytes than space, tab, line feed, vertical tab, form feed, carriage return. Windows
are judged on the input. Two windows are held equal when their 64-bit hashes are.

Defined results: a null text has no words; fewer words than ``k`` are never removed; a window that only repeats in its
own document, or in rows of the same id, stays; a null id is compared with nothing; extra columns do not take part; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrays import Rolling, WordHashes, from_steps, pack, steps, unpack
from tracewell.llm.batches import for_texts
from tracewell.llm.membership import bit_of, bitmap, may_contain, rows_in
from tracewell.session import materialise

WINDOW = 13
#: Windows held in a block; text bytes a hash range stands for. Both bound memory, neither drops anything.
BLOCK_WINDOWS = 4_000_000
RANGE_BYTES = 16_000_000
LEAST_RANGES = 64

_BLOCK = "part int, hashes binary, places binary, docs binary, tags binary, starts binary, hit_docs binary, hit_tags binary, hit_places binary"  # noqa: E501
_HIT = "doc_id long, tag long, places binary"
_RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept string"


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body, and a tag that tells rows of one id apart: the hash of the text, or 0 where all ids differ."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = for_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), body.cast("binary").alias("body"))
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return rows.withColumn("tag", F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("body"))


def _blocks(k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling = WordHashes(), Rolling(k)
        held, total = [], 0
        for batch in batches:
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
            for doc, tag, body in zip(ids, tags, batch.column("body"), strict=True):
                if doc is None:
                    continue
                found = rolling(words.of(body.as_py().split()))
                if len(found):
                    held.append((doc, tag, found))
                    total += len(found)
                if total >= BLOCK_WINDOWS:
                    yield _block(held, parts)
                    held, total = [], 0
        if held:
            yield _block(held, parts)

    return run


def _block(held: list[tuple[int, int, np.ndarray]], parts: int) -> pa.RecordBatch:
    """Rows of one block, one for each range. A place counts the block's windows, documents in the order of their ids."""
    held.sort(key=lambda x: x[0])
    docs = np.array([x[0] for x in held], np.int64)
    tags = np.array([x[1] for x in held], np.int64)
    sizes = np.array([len(x[2]) for x in held], np.int64)
    starts = (np.cumsum(sizes) - sizes).astype(np.uint32)
    hashes = np.concatenate([x[2] for x in held])
    held.clear()
    order = np.argsort(hashes, kind="stable").astype(np.uint32)
    hashes = hashes[order]
    row = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    least = docs[row[np.flatnonzero(new)]][np.cumsum(new) - 1]
    known = docs[row] > least
    hit_rows, hit_places = row[known], order[known]
    keep = ~known
    hashes, places = hashes[keep], order[keep]
    # Ranges are equal shares of the hash space; sorted hashes make each of them a slice.
    edges = np.searchsorted(hashes, [np.uint64((p << 64) // parts) for p in range(1, parts)])
    edges = np.concatenate([[0], edges, [len(hashes)]])
    hit_part = hit_rows % parts
    by_part = np.lexsort((hit_places, hit_part))
    hit_rows, hit_places, hit_part = hit_rows[by_part], hit_places[by_part], hit_part[by_part]
    hit_edges = np.searchsorted(hit_part, np.arange(parts + 1))
    hit_places = hit_places - starts[hit_rows]
    row = row[keep]
    rows: list[list] = [[] for _ in range(9)]
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        c, d = hit_edges[p], hit_edges[p + 1]
        if a == b and c == d:
            continue
        # Only the documents with a window in the range go along, whatever the block holds.
        own, hits = np.unique(row[a:b]), hit_rows[c:d]
        values = (p, steps(hashes[a:b]), pack(places[a:b]), steps(docs[own]), pack(tags[own]), steps(starts[own]),
                  pack(docs[hits]), pack(tags[hits]), pack(hit_places[c:d]))
        for column, v in zip(rows, values, strict=True):
            column.append(v)
    names = ["part", "hashes", "places", "docs", "tags", "starts", "hit_docs", "hit_tags", "hit_places"]
    kinds = [pa.int32()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)


def _repeats(group: pd.DataFrame) -> pd.DataFrame:
    """Hits of one range: packed places of windows that also start in a document with a smaller id."""
    hashes, docs, tags, places = [], [], [], []
    for r in group.itertuples(index=False):
        if not r.hashes:
            continue
        own, starts = unpack(r.places, np.uint32), from_steps(r.starts, np.uint32)
        at = np.searchsorted(starts, own, side="right") - 1
        hashes.append(from_steps(r.hashes, np.uint64))
        docs.append(from_steps(r.docs, np.int64)[at])
        tags.append(unpack(r.tags, np.int64)[at])
        places.append(own - starts[at])
    known = [(unpack(r.hit_docs, np.int64), unpack(r.hit_tags, np.int64), unpack(r.hit_places, np.uint32))
             for r in group.itertuples(index=False) if r.hit_docs]
    if hashes:
        h, d, t, p = map(np.concatenate, (hashes, docs, tags, places))
        del hashes, docs, tags, places
        order = np.argsort(h)
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        least = np.minimum.reduceat(d, first)
        late = d > np.repeat(least, np.diff(np.append(first, len(h))))
        known.append((d[late], t[order[late]], p[order[late]]))
    if not known:
        return pd.DataFrame({"doc_id": [], "tag": [], "places": []})
    d, t, p = (np.concatenate(x) for x in zip(*known, strict=True))
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    if not len(d):
        return pd.DataFrame({"doc_id": [], "tag": [], "places": []})
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
    parts = np.split(p, first[1:])
    return pd.DataFrame({"doc_id": d[first], "tag": t[first], "places": [pack(x) for x in parts]})


def repeated_windows(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (hash of the text), places (packed starts of windows that repeat an earlier document), written."""
    return _repeated(_input(docs, id_col, text_col), k)


def _repeated(rows: DataFrame, k: int) -> DataFrame:
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    blocks = rows.mapInArrow(_blocks(k, parts), _BLOCK)
    return materialise(blocks.groupBy("part").applyInPandas(_repeats, _HIT), "window-hits")


def _cut(k: int, bits: bytes | None):
    """Words, removed intervals and kept text. With ``bits``: only rows that have no repeats for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                none = pc_not_null(batch.column("doc_id"))
                sure = ~may_contain(bits, batch.column("bit").to_numpy()) | ~none
                batch = batch.filter(pa.array(sure))
            out: list[list] = [[] for _ in range(5)]
            places = batch.column("places") if bits is None else [None] * len(batch)
            for doc, body, own in zip(batch.column("doc_id").to_pylist(), batch.column("body"), places, strict=True):
                words, removed, gone = body.as_py().split(), [], 0
                n = len(words)
                own = own.as_py() if own is not None else None
                if own:
                    at = np.unique(np.concatenate([unpack(x, np.uint32) for x in own])).astype(np.int64)
                    first = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + k]))
                    ends = np.append(at[first[1:] - 1], at[-1]) + k
                    removed = [{"start": a, "end": b} for a, b in zip(at[first].tolist(), ends.tolist(), strict=True)]
                    kept, last = [], 0
                    for r in removed:
                        kept += words[last : r["start"]]
                        last = r["end"]
                        gone += r["end"] - r["start"]
                    words = kept + words[last:]
                for column, v in zip(out, (doc, n, gone, removed, b" ".join(words)), strict=True):
                    column.append(v)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())
            columns = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return run


def pc_not_null(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of words), kept (words joined by spaces), for every row."""
    rows = _input(docs, id_col, text_col)
    hits = _repeated(rows, k)
    bits = bitmap(hits, "doc_id", "tag")
    marked = rows.withColumn("bit", bit_of("doc_id", "tag"))
    clean = marked.select("doc_id", "body", "bit").mapInArrow(_cut(k, bits), _RESULT)
    # Each range and block gives a document one packed array: no more numbers than the document has windows.
    by_doc = hits.groupBy("doc_id", "tag").agg(F.collect_list("places").alias("places"))
    held = marked.where("doc_id IS NOT NULL").mapInArrow(rows_in(bits), "doc_id long, body binary, tag long, bit int")
    cut = held.join(by_doc, ["doc_id", "tag"], "left").select("doc_id", "body", "places")
    return clean.unionByName(cut.mapInArrow(_cut(k, None), _RESULT))
