"""The trie of all conversation prefixes, by a splitter skeleton.

A conversation becomes its path: 16 bytes (of SHA-256) for each turn's role and text, so that conversations with a common prefix stand
next to each other in the order of paths. Splitters drawn from a bounded sample cut that order, by (path, id), into shards. The prefixes of
the splitters are the skeleton: a node can lie in two shards only if a splitter lies inside its subtree, and then it is a prefix of
that splitter. The skeleton is broadcast. Each shard is sorted and read once with a stack of open nodes; nodes outside the skeleton are
finished where they are, and those of the skeleton leave one partial aggregate a shard, combined by a reduction over shards
and rolled up over the skeleton. A hot prefix, or a conversation that occurs many times, is cut like any other run of rows.

Bounds: the sample is ``SAMPLES`` rows a shard, each cut after ``SAMPLE_BYTES`` over their number (128 turns at ``MAX_SHARDS``), so the skeleton has at
most ``MAX_SHARDS`` x ``SAMPLE_BYTES`` / 16 / rows sampled nodes, whatever the table. Conversations are sequences in one row (20 bytes
a turn, without texts). The ids that end at one node are hashed in their order, which is sequential by
definition: shards send them packed, and one reader at a time hashes them in a stream without holding them.

Defined results: a null role or text is empty; turns are ordered by ``turn``, null first, equal ones by their hash; rows
without a conversation id take no part; a repeated row is a turn of its own; a conversation without turns is a member of the root; extra
columns do not take part; an empty table has no root and gives an empty result. Equal turns are turns equal in 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.pareto_mix import words
from tracewell.session import materialise

WIDTH = 16
SHARD_BYTES = 8_000_000
LEAST_SHARDS, MAX_SHARDS = 16, 4096
SAMPLES = 8
SAMPLE_BYTES = 64_000_000
#: Characters of joined ids that a shard sends in one row.
PIECE = 1_000_000
FLUSH = 20_000
_NO_ENDS = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_OUT = pa.schema(
    [("kind", pa.int32()), ("node", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
     ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string())]
)
_DDL = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'int' if f.type == pa.int32() else 'long'}" for f in _OUT)
#: Kinds of rows that shards send: finished nodes, finished ones below the skeleton, partial aggregates, ids that end at a skeleton node.
DONE, BELOW, PARTIAL, ENDS = range(4)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, steps (array of digest and words) of each conversation, in the order of its turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length in front keeps (role, text) apart from any other cut of the same characters.
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), digest.alias("digest"), words("text").cast("int").alias("words")).alias("step"),
    )
    ordered = F.sort_array(F.collect_list("step"))
    return rows.groupBy("conv_id").agg(
        F.transform(ordered, lambda s: F.struct(s["digest"].alias("digest"), s["words"].alias("words"))).alias("steps")
    )


def share_heads(seqs: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Each sequence with its first h steps taken from the first sequence of its block of ids, h = CRC-32 of its id modulo ``heads``."""
    conv = F.col("conv_id")
    first = seqs.where(conv % block == 0).select(conv.alias("base"), F.slice("steps", 1, heads - 1).alias("head"))
    h = (F.crc32(conv.cast("string").cast("binary")) % heads).cast("int")
    rows = seqs.withColumn("base", conv - conv % block).withColumn("h", h).join(first, "base", "left")
    none = F.slice("steps", 1, 0)
    own = F.when(F.size("steps") > F.col("h"), F.slice("steps", F.col("h") + 1, F.size("steps"))).otherwise(none)
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), 1, F.col("h")), own).alias("steps"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps as two byte strings: the path, and the words of each turn."""
    for batch in batches:
        steps = batch.column("steps")
        counts = steps.value_lengths().to_numpy(zero_copy_only=False)
        cuts = [0, *np.cumsum(counts).tolist()]
        flat = steps.flatten()
        path = b"".join(flat.field("digest").to_pylist())
        size = flat.field("words").to_numpy(zero_copy_only=False).astype("<i4").tobytes()
        pairs = list(zip(cuts, cuts[1:], strict=False))
        columns = [batch.column("conv_id"), pa.array([path[WIDTH * a : WIDTH * b] for a, b in pairs], pa.binary()),
                   pa.array([size[4 * a : 4 * b] for a, b in pairs], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "path", "sizes"])


class Skeleton:
    """Splitters, and the trie of all their prefixes: node 0 is the root, parents come before their children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent, self.depth, self.child = [-1], [0], {}
        for path, _ in splitters:
            node = 0
            for i in range(0, len(path), WIDTH):
                key = (node, path[i : i + WIDTH])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def rolled_up(self, partials: dict[int, dict]) -> list[tuple]:
        """node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens of every skeleton node."""
        if not partials:
            return []
        n = len(self.parent)
        children = [partials[i]["n_children"] for i in range(n)]
        leaves = [partials[i]["n_leaves"] for i in range(n)]
        saved = [partials[i]["saved_tokens"] for i in range(n)]
        for i in range(n - 1, -1, -1):
            up = self.parent[i]
            leaves[i] += children[i] == 0
            saved[i] += (partials[i]["n_convs"] - 1) * partials[i]["words"]
            if up >= 0:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        first = [partials[i]["conv_id"] for i in range(n)]
        return [
            (i, first[i], self.depth[i], first[up] if (up := self.parent[i]) >= 0 else None, partials[i]["n_convs"], children[i], leaves[i], saved[i])
            for i in range(n)
        ]


def _dealt(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = skeleton.value.shard
        for batch in batches:
            of = map(shard, batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            yield batch.append_column("shard", pa.array(list(of), pa.int32()))

    return run


class _Node:
    __slots__ = ("conv_id", "n_convs", "n_children", "n_leaves", "saved", "words", "skeleton", "waiting", "ends", "held")

    def __init__(self, words: int, skeleton: int):
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = None, 0, 0, 0, 0
        self.words, self.skeleton, self.waiting = words, skeleton, []
        self.ends, self.held = [] if skeleton >= 0 else None, 0


class _Shard:
    """Reads the sorted rows of one shard; ``rows`` gets what can be sent."""

    def __init__(self, skeleton: Skeleton, rows: list[tuple]):
        self.child, self.rows = skeleton.child, rows
        self.open, self.path = [_Node(0, 0)], b""

    def take(self, path: bytes, sizes: np.ndarray, conv_id: int) -> None:
        keep = 0
        while path[keep : keep + WIDTH] == self.path[keep : keep + WIDTH] and keep < len(path) and keep < len(self.path):
            keep += WIDTH
        self.close(keep // WIDTH + 1)
        for i in range(keep, len(path), WIDTH):
            up = self.open[-1]
            node = self.child.get((up.skeleton, path[i : i + WIDTH]), -1) if up.skeleton >= 0 else -1
            self.open.append(_Node(int(sizes[i // WIDTH]), node))
        self.path = path
        last = self.open[-1]
        last.n_convs += 1
        last.conv_id = conv_id if last.conv_id is None else min(conv_id, last.conv_id)
        text = str(conv_id)
        if last.skeleton >= 0:
            last.ends.append(text)
            last.held += len(text)
            if last.held > PIECE:
                self.send_ends(last)
        elif last.ends is None:
            last.ends = hashlib.sha256(text.encode())
        else:
            last.ends.update(b"," + text.encode())

    def send_ends(self, node: _Node) -> None:
        if node.ends:
            joined = ",".join(node.ends)
            self.rows.append((ENDS, node.skeleton, int(node.ends[0]), None, None, None, None, None, None, None, joined))
        node.ends, node.held = [], 0

    def close(self, depth: int) -> None:
        """Close the open nodes from ``depth`` down."""
        while len(self.open) > depth:
            node, at = self.open.pop(), len(self.open)
            up = self.open[-1] if at else None
            if up is not None:
                up.n_convs += node.n_convs
                up.conv_id = node.conv_id if up.conv_id is None else min(node.conv_id, up.conv_id)
            if node.skeleton >= 0:
                self.send_ends(node)
                self.rows.append((PARTIAL, node.skeleton, node.conv_id, at, None, node.n_convs, node.n_children, node.n_leaves, node.saved, node.words, None))
                continue
            saved = node.saved + (node.n_convs - 1) * node.words
            leaves = node.n_leaves or 1
            up.n_children += 1
            up.n_leaves += leaves
            up.saved += saved
            for first, level, *counts, own_sha in node.waiting:
                self.rows.append((DONE, None, first, level, node.conv_id, *counts, None, own_sha))
            sha = node.ends.hexdigest() if node.ends is not None else _NO_ENDS
            if up.skeleton >= 0:
                self.rows.append((BELOW, up.skeleton, node.conv_id, at, None, node.n_convs, node.n_children, leaves, saved, None, sha))
            else:
                up.waiting.append((node.conv_id, at, node.n_convs, node.n_children, leaves, saved, sha))


def _finished(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        shard, now = None, None

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(_OUT)
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)
            rows.clear()
            return out

        for batch in batches:
            for own, path, sizes, conv_id in zip(
                batch.column("shard").to_pylist(), batch.column("path").to_pylist(), batch.column("sizes").to_pylist(), batch.column("conv_id").to_pylist(),
                strict=True,
            ):
                if own != now:
                    if shard is not None:
                        shard.close(0)
                    shard, now = _Shard(skeleton.value, rows), own
                shard.take(path, np.frombuffer(sizes, "<i4"), conv_id)
                if len(rows) > FLUSH:
                    yield flush()
        if shard is not None:
            shard.close(0)
        yield flush()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of joined ids, sorted by node and first id, to the SHA-256 of all of a node; holds one piece at a time."""
    now, sha = None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node == now:
                sha.update(b"," + piece.encode())
            else:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(piece.encode())
    if sha is not None:
        done.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends"])


def splitters(paths: DataFrame, shards: int | None = None) -> list[tuple[bytes, int]]:
    """At most ``MAX_SHARDS`` - 1 places in the order of (path, id), from a bounded sample drawn by the hash of the id."""
    n, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.length("path") + F.length("sizes") + 8), F.lit(0))).first()
    shards = min(MAX_SHARDS, shards or max(LEAST_SHARDS, size // SHARD_BYTES))
    wanted = min(n, shards * SAMPLES)
    if not wanted or shards < 2:
        return []
    drawn = F.pmod(F.xxhash64("conv_id", F.lit(13)), F.lit(1 << 53)) < int((1 << 53) * wanted / n)
    cut = SAMPLE_BYTES // wanted // WIDTH * WIDTH
    # Ids are distinct: about ``wanted`` rows come, each cut to its share of SAMPLE_BYTES.
    sample = paths.where(drawn | (F.lit(n) <= wanted)).select(F.substring("path", 1, cut).alias("path"), "conv_id").toArrow()
    keys = sorted(zip(sample["path"].to_pylist(), sample["conv_id"].to_pylist(), strict=True))
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []


def prefix_trie(seqs: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of sequences (conv_id: distinct, steps: array of digest and words): the columns of ``RESULT``."""
    spark = seqs.sparkSession
    paths = materialise(seqs.mapInArrow(_packed, "conv_id long, path binary, sizes binary"), "trie-paths")
    skeleton = Skeleton(splitters(paths, shards))
    shared = spark.sparkContext.broadcast(skeleton)
    dealt = paths.mapInArrow(_dealt(shared), "conv_id long, path binary, sizes binary, shard int")
    dealt = dealt.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    sent = materialise(dealt.mapInArrow(_finished(shared), _DDL), "trie-nodes", "kind")

    partials = sent.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    # One row for each skeleton node: bounded as the skeleton is.
    whole = skeleton.rolled_up({r["node"]: r.asDict() for r in partials.collect()})
    ddl = "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    top = spark.createDataFrame(whole, ddl)
    pieces = sent.where(F.col("kind") == ENDS).select("node", "conv_id", "ends")
    ends = pieces.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hashed, "node long, ends string")
    top_rows = top.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS)))

    done = sent.where(F.col("kind") == DONE).withColumn("ends_sha256", F.col("ends"))
    first = F.broadcast(top.select("node", F.col("conv_id").alias("top_conv_id")))
    below = sent.where(F.col("kind") == BELOW).join(first, "node").withColumn("parent_conv_id", F.col("top_conv_id"))
    below = below.withColumn("ends_sha256", F.col("ends"))
    return done.select(RESULT).unionByName(below.select(RESULT)).unionByName(top_rows.select(RESULT))
