"""Token counts of a piece model by heap-and-linked-list byte-pair merging; no ids are made.

The characters of a word are a linked list and the adjacent pairs that join to a piece are a heap by rank. The lowest rank, leftmost among
equals, is popped again and again and its two symbols become one. The count is the number of initial symbols less the number of
merges; a character outside the vocabulary is as many symbols as it has UTF-8 bytes.

A text is cut where no merge can reach across: before a space mark that follows another character, if no piece of the model
holds one there, likewise between a letter and a point, and around line ends and tabs that no longer piece holds. Merges happen within parts only, so counts add up exactly. Most
parts repeat: a Python worker remembers the counts of those met last, ``KEEP`` and up to as many older ones, over all its tasks.

Defined results: a null or empty text has no tokens; strings that look like special tokens are ordinary text; repeated rows count
each; a null id stays null; extra columns do not take part; an empty table gives an empty result. A very long part is merged in n log n.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.batches import for_texts

KEEP = 300_000
#: Longer parts are not remembered: they seldom repeat, and this bounds the memory.
KEEP_LENGTH = 64
SPACE = "▁"
#: A text is cut between a small letter and one of these, unless a piece holds the two together.
POINTS = ".,;:!?\"')|"


class PieceCounter(dict):
    """part -> tokens. Takes the ranks of pieces: lower merges first."""

    def __init__(self, ranks: dict[str, int], prefix: bool = True):
        super().__init__()
        self.ranks, self.prefix = ranks, prefix
        self.older: dict[str, int] = {}
        self.single = {piece for piece in ranks if len(piece) == 1}
        inner = {c for piece in ranks if len(piece) > 1 for c in piece}
        alone = "".join(c for c in "\n\r\t" if c not in inner)
        if any(b == SPACE != a for piece in ranks for a, b in zip(piece, piece[1:], strict=False)):
            self.parts = re.compile(r"(?s).+").findall
        else:
            points = "".join(c for c in POINTS if not any(re.search(f"[a-z]{re.escape(c)}", piece) for piece in ranks))
            rest = f"[^{SPACE}{re.escape(alone)}]"
            word = f"(?:{rest}*[a-z](?=[{re.escape(points)}])|{rest}+)" if points else f"{rest}+"
            self.parts = re.compile(f"{SPACE}*{word}|{SPACE}+" + (f"|[{re.escape(alone)}]" if alone else "")).findall

    def __missing__(self, part: str) -> int:
        n = self.older.get(part)
        if n is None:
            n = self.merged(part)
        if len(part) <= KEEP_LENGTH:
            if len(self) >= KEEP:
                self.older = dict(self)
                self.clear()
            self[part] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        return sum(map(self.__getitem__, self.parts(SPACE + text if self.prefix else text)))

    def merged(self, part: str) -> int:
        """Initial symbols less merges."""
        rank = self.ranks.get
        symbols: list[str] = list(part)
        count = n = len(symbols)
        if not self.single.issuperset(symbols):
            count = sum(1 if c in self.single else len(c.encode()) for c in symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, joined) for i in range(n - 1) if (r := rank(joined := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            # Either side may have been merged since the pair was filed.
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(right := joined + symbols[k])) is not None:
                    heapq.heappush(queue, (r, i, right))
            if (h := before[i]) >= 0 and (r := rank(left := symbols[h] + joined)) is not None:
                heapq.heappush(queue, (r, h, left))
        return count


def read_model(path: str) -> PieceCounter:
    """The counter of a model file on this machine. Models that need more than ranks (other normalisation, other kinds of
    pieces, no byte fallback) are refused rather than counted wrongly."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kind = proto.normalizer_spec, model.ModelProto.SentencePiece
    plain = not norm.precompiled_charsmap and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if proto.trainer_spec.model_type != model.TrainerSpec.BPE or not plain or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only byte-pair models with byte fallback and without normalisation are counted")
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
        raise ValueError(f"{path}: pieces of the user's own and unused pieces are not counted")
    pieces = [(p.piece, p.score) for p in proto.pieces if p.type == kind.NORMAL]
    places = {score: i for i, score in enumerate(sorted({s for _, s in pieces}, reverse=True))}
    return PieceCounter({piece: places[score] for piece, score in pieces}, norm.add_dummy_prefix)


#: The counter of the model a worker used last, by the number of its broadcast.
_LAST: dict[int, PieceCounter] = {}


def _counted(ranks, number: int, prefix: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _LAST:
            _LAST.clear()
            _LAST[number] = PieceCounter(ranks.value, prefix)
        counter = _LAST[number]
        for batch in batches:
            n = [counter.text(t.as_py()) for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. The model's ranks are broadcast: a vocabulary, whatever the data."""
    counter = read_model(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(counter.ranks)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = for_texts(docs).select(F.col(id_col).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_counted(shared, shared._jbroadcast.id(), counter.prefix), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
