import hashlib
import math
import random
import zlib

import pytest

from tracewell.llm import prefix_trie as t
from tracewell.llm.queries import QUERIES

COLUMNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]  # the remainder has the sign of the id
    return out


def plain(convs):
    """Every prefix with its members."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        n_words = len(path[-1][1].split()) if path else 0
        saved[path] = (len(members[path]) - 1) * n_words + sum(saved[x] for x in below)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    assert df.columns == t.RESULT
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def cases(rng, n=300):
    rows = []
    for c in range(n):
        turns = [(rng.choice("ua"), rng.choice(["x", "y y", "z z z", ""])) for _ in range(rng.randint(1, 7))]
        if c % 3 == 0:  # a third of all conversations are one
            turns = [("u", "hot start"), ("a", "the same"), ("u", "again and again")]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(1000, i, "u", f"turn {i}") for i in range(500)]  # long ones with a long common part
    rows += [(1001, i, "u", f"turn {i if i != 400 else 'other'}") for i in range(500)]
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40, None])
def test_like_every_prefix_with_its_members(spark, monkeypatch, shards):
    if shards == 40:
        monkeypatch.setattr(t, "PIECE", 20)  # many pieces of ids
        monkeypatch.setattr(t, "SAMPLE_BYTES", 40 * t.SAMPLES * 48)  # splitters of three turns
    rows = cases(random.Random(shards))
    seqs = t.share_heads(t.sequences(spark.createDataFrame(rows, COLUMNS).repartition(5)))
    assert got(t.prefix_trie(seqs, shards)) == plain(rebuilt(rows))


def test_hot_conversation_is_cut(spark):
    rows = [(c, 0, "u", "the same") for c in range(2000)] + [(5000 + c, 0, "u", f"other {c}") for c in range(500)]
    paths = t.sequences(spark.createDataFrame(rows, COLUMNS)).mapInArrow(t._packed, "conv_id long, path binary, sizes binary")
    skeleton = t.Skeleton(t.splitters(paths, 10))
    counts = [0] * 10
    for r in paths.collect():
        counts[skeleton.shard(bytes(r.path), r.conv_id)] += 1
    assert max(counts) < 900


def test_query_of_every_case(spark, tmp_path):
    rows = [(0, 1, "u", "a"), (0, None, None, None), (20, 0, "u", "b b"), (20, 0, "u", "b b"), (21, 5, "a", None), (22, None, "a", ""), (None, 0, "u", "x")]
    rows += [(c, 0, "u", "only") for c in range(100, 140)]  # some have more heads than turns
    rows += [(241, 0, "u", "long " * 30_000), (-7, 0, "u", "negative")]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS path", "1 AS node", "2 AS base", "3 AS h", "4 AS steps", "5 AS shard")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert got(QUERIES["op13_prefix_trie"](spark, str(tmp_path))) == plain(rebuilt(rows))
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["op13_prefix_trie"](spark, str(tmp_path / "none")).count() == 0
