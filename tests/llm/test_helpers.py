import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import arrays, graph, membership, sampling
from tracewell.llm.batches import ROWS, for_texts


def test_rolling_hashes_agree_exactly_with_equal_windows():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 3, 4000).astype(np.uint64)
    rolling = arrays.Rolling(5)
    got = rolling(items)
    seen = {}
    for i, h in enumerate(got.tolist()):
        assert seen.setdefault(tuple(items[i : i + 5].tolist()), h) == h
    assert len(set(seen.values())) == len(seen) and len(got) == 3996
    assert np.array_equal(rolling(items[7:900]), got[7:896]) and len(rolling(items[:4])) == 0


def test_packed_arrays_come_back():
    for a in (np.array([], np.int64), np.array([-1, 0, 2**40], np.int64), np.arange(9, dtype=np.uint32)):
        assert np.array_equal(arrays.unpack(arrays.pack(a), a.dtype), a)
    assert list(arrays.pieces([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 400)] + [(5, 5)]
    edges += [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(220)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_has_every_member(spark):
    df = spark.range(0, 5000)
    bits = membership.bitmap(df.where("id % 10 = 0"), "id")
    at = df.select("id", membership.bit_of("id").alias("bit")).toPandas()
    inside = membership.may_contain(bits, at["bit"].to_numpy())
    assert inside[at["id"] % 10 == 0].all() and inside.mean() < 0.11


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(0, 20_000)
    got = sampling.hash_sample(df, 20_000, 1000, "id")
    assert 850 < got.count() < 1150 and sorted(got.collect()) == sorted(sampling.hash_sample(df, 20_000, 1000, "id").collect())
    assert sampling.hash_sample(df, 20_000, 30_000, "id").count() == 20_000
    same = df.select(F.lit(1).alias("id"))
    assert sampling.hash_sample(same, 20_000, 1000, "id").count() <= 2000


def test_batches_are_only_lowered(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10")
    for_texts(spark.range(1))
    assert spark.conf.get(key) == "10"
    spark.conf.unset(key)
    for_texts(spark.range(1))
    assert int(spark.conf.get(key)) == ROWS
    spark.conf.unset(key)
