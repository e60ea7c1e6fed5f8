"""Byte-level BPE by replaying merges over a vocabulary of words.

A task holds the distinct words of its documents as one array of tokens with links to the next and previous token of
the word. An inverted index maps each token pair to the positions where it stands. Merges are applied in rank order:
every position of the pair in the whole vocabulary at once, after which only the pairs to the left and right of these
positions are looked up and filed again. Documents are then spelt out from the encoded words. The words met stay encoded for
the following documents of the task, up to a bound.

Result: for each text exactly what encoding each match of the split pattern separately gives when the lowest rank,
leftmost pair is merged first. Merges of one rank are applied together, which is the same as long as no merge makes a
pair of a rank not above its own; words where that happens are noticed and encoded one pair at a time.

Defined results: a null text is the empty text, which has no tokens; special tokens are ordinary text; repeated
rows are encoded each; extra columns do not take part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import for_texts, giving_back

#: Words that a task keeps encoded; text bytes whose new words are replayed together.
KEEP_WORDS = 100_000
REPLAY_BYTES = 6_000_000
_NONE = np.int32(2**31 - 1)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a text file of base64 token and rank; of vocabulary size, whatever the data."""
    if "://" in path:
        lines = (r[0].encode() for r in spark.read.text(path).toLocalIterator())
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Tokens, and the rank of each pair of tokens whose joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**63 - 1))
        self.values = np.append(np.array(values, np.int32)[order], _NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        ids: list[bytes | None] = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is None:
                todo.append(i)
            else:
                ids[i] = whole.to_bytes(4, "little")
        if todo:
            for i, x in zip(todo, self._replay([words[i] for i in todo]), strict=True):
                ids[i] = x
        return ids

    def _replay(self, words: list[bytes]) -> list[bytes]:
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        ends = np.cumsum([len(w) for w in words])
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends[:-1]] = -1
        pair = np.full(n, _NONE, np.int32)  # rank of the pair that starts here
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.rank(token[inner], token[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(positions: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks < _NONE
            positions, ranks = positions[some], ranks[some]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, own in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(queue, r)

        file(inner, pair[inner])
        odd: list[np.ndarray] = []
        while queue:
            rank = heapq.heappop(queue)
            filed = index.pop(rank)
            left = np.unique(np.concatenate(filed))
            left = left[pair[left] == rank]
            if not len(left):
                continue
            right = after[left]
            if len(left) > 1 and (right[:-1] == left[1:]).any():  # overlaps: the leftmost goes first
                keep, end = np.ones(len(left), bool), -1
                for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                    if a == end:
                        keep[i] = False
                    else:
                        end = b
                left, right = left[keep], right[keep]
            following = after[right]
            met = token[following]
            token[left] = rank
            token[right] = -1
            beside = np.flatnonzero((following >= 0) & (token[following] != met))
            if len(beside):  # the next occurrence follows at once: one by one, this pair would have stood there first
                early = self.rank(np.full(len(beside), rank), met[beside]) <= rank
                if early.any():
                    odd.append(left[beside[early]])
            pair[right] = _NONE
            after[left] = following
            has_next = following >= 0
            before[following[has_next]] = left[has_next]
            pair[left] = _NONE
            a = left[has_next]
            pair[a] = self.rank(token[a], token[after[a]])
            b = before[left]
            b = b[b >= 0]
            pair[b] = self.rank(token[b], token[after[b]])
            touched = np.concatenate([a, b])
            ranks = pair[touched]
            if (ranks <= rank).any():
                odd.append(touched[ranks <= rank])
            file(touched, ranks)
        alive = token >= 0
        data = token[alive].astype("<u4").tobytes()
        upto = np.cumsum(alive)[ends - 1] * 4
        cuts = [0, *upto.tolist()]
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if odd:
            for i in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist():
                out[i] = self.one_by_one(words[i])
        return out

    def one_by_one(self, word: bytes) -> bytes:
        """The same by single merges: lowest rank first, leftmost among equals."""
        parts = [bytes([b]) for b in word]
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[int, int, bytes]] = []

        def file(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                joined = parts[i] + parts[after[i]]
                if joined in self.ranks:
                    heapq.heappush(queue, (self.ranks[joined], i, joined))

        for i in range(len(parts)):
            file(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, b""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            file(i)
            file(before[i])
        return b"".join(self.ranks[p].to_bytes(4, "little") for p in parts if p)


class _Words(dict):
    """word -> number, in the order of first meeting."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _encoder(ranks, pattern: str, keep_words: int | None = None, replay_bytes: int | None = None):
    keep_words, replay_bytes = keep_words or KEEP_WORDS, replay_bytes or REPLAY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        merges, words, spelt = Merges(ranks.value), _Words(), []
        for batch in batches:
            texts, start = batch.column("body"), 0
            while start < len(texts):
                held, size = [], 0
                while start < len(texts) and (not held or size < replay_bytes):
                    text = texts[start].as_py()
                    found = split(text)
                    held.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                    size += len(text)
                    start += 1
                new = list(words)[len(spelt) :]
                spelt += merges.replay([w.encode() for w in new])
                ids = [b"".join(map(spelt.__getitem__, own.tolist())) for own in held]
                first = start - len(held)
                columns = [batch.column("doc_id").slice(first, len(held)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                           pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])
                if len(words) > keep_words:
                    words, spelt = _Words(), []

    return run


def _decoder(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(ranks.value.values()) + 1)
        for token, rank in ranks.value.items():
            tokens[rank] = token
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x.as_py(), "<u4").tolist())) for x in batch.column("ids")]
            yield batch.append_column("decoded", pa.array(texts, pa.binary()))

    return run


def _both(ranks, *args):
    encoded, decoded = _encoder(ranks, *args), _decoder(ranks)
    return lambda batches: decoded(encoded(batches))


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    and_decode: bool = False,
    keep_words: int | None = None,
    replay_bytes: int | None = None,
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every row. ``ranks`` is broadcast: a vocabulary.

    ``and_decode`` adds ``decoded``, the bytes that the ids stand for, in the same pass. ``keep_words`` and ``replay_bytes`` bound
    the memory of a task (``KEEP_WORDS`` and ``REPLAY_BYTES`` by default); lower ones merge more words again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = for_texts(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary"
    if and_decode:
        return rows.mapInArrow(giving_back(_both(shared, pattern, keep_words, replay_bytes)), f"{schema}, decoded binary")
    return rows.mapInArrow(giving_back(_encoder(shared, pattern, keep_words, replay_bytes)), schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The same rows with ``decoded``: the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(_decoder(shared), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
