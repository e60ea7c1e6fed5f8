import random

import numpy as np
from cases import SF, docs

from tracewell.llm import order_minhash as o


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def in_order(a, b):
    """Share of the longer text in a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(len(a), len(b))


def classes(rows):
    """Least id of the component, all pairs compared."""
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    own = [(i, (t or "").split()) for i, t in rows if i is not None]
    sets = [shingles(x) for _, x in own]
    for a in range(len(own)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and in_order(own[a][1], own[b][1]) >= 0.8:
                    x, y = find(own[a][0]), find(own[b][0])
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def got(df):
    return {r.doc_id: r.class_id for r in o.near_duplicates(df).collect()}


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 2500")
    rows = [tuple(r) for r in df.collect()]
    assert got(df) == classes(rows)


def test_group_of_near_copies(spark, monkeypatch):
    """Edits chain on: most pairs are below the threshold, so buckets stay split and go by prefixes."""
    rng = random.Random(4)
    base = [str(rng.randint(0, 10**6)) for _ in range(120)]
    family, rows = [base], []
    for _ in range(110):
        copy = list(rng.choice(family))
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = str(rng.randint(0, 10**6))
        family.append(copy)
    rows = [(i, " ".join(f)) for i, f in enumerate(family)]
    monkeypatch.setattr(o, "SMALL_BUCKET", 3)
    assert got(docs(spark, [(i, t, "s") for i, t in rows])) == classes(rows)


def test_cases(spark):
    df = docs(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = {i: c for i, c in classes([(i, t) for i, t in rows if i != 6]).items()} | {6: 6, None: None}
    assert got(df) == want
    kept = o.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["None", *(str(i) for i, c in want.items() if i is not None and i == c)])
    assert o.near_duplicates(df.limit(0)).count() == 0 and o.one_of_each(df.limit(0)).count() == 0


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 8)):
            i = rng.integers(0, len(b))
            b = np.delete(b, i) if rng.random() < 0.5 and len(b) > 1 else np.insert(b, i, rng.integers(0, 6))
        assert o.aligned(a, b.astype(np.uint64)) == (in_order(a.tolist(), b.tolist()) >= 0.8 - 1e-9)


def test_sketches_mind_order():
    words = [np.uint64(x) for x in range(1000, 1060)]
    a = o.mix64(np.array(words, np.uint64))
    same = (o.sketches(a) == o.sketches(a)).mean()
    turned = (o.sketches(a) == o.sketches(np.concatenate([a[30:], a[:30]]))).mean()
    assert same == 1 and turned < 0.5


def test_few_kmers(spark):
    """Pairs that no sketch, or not every draw of sketches, brings together."""
    rng = random.Random(5)
    new = lambda n: [str(rng.randint(0, 10**9)) for _ in range(n)]
    rows = []
    for n in [8] * 5 + [9] * 100 + list(range(10, 40)):
        base = new(n)
        rows += [base, base + new(1)]
    for _ in range(300):
        base = new(14)
        rows += [base, base[:-1] + new(1)]
    rows += [["x"] * n for n in (5, 6, 7)]
    rows = [(i, " ".join(f)) for i, f in enumerate(rows)]
    assert got(docs(spark, [(i, t, "s") for i, t in rows])) == classes(rows)
    # One text under many of one word more: only pairs with it are candidates.
    base = new(8)
    rows = [(0, " ".join(base))] + [(i, " ".join(base + new(1))) for i in range(1, 60)]
    assert set(got(docs(spark, [(i, t, "s") for i, t in rows])).values()) == {0}


def test_repeated_kmers(spark):
    """The labelled k-mers of a pair differ much more than its sets."""
    rng = random.Random(6)
    rows = []
    for i in range(10):
        base = [str(rng.randint(0, 10**9)) for _ in range(150)]
        line = [f"{w}{i}" for w in "abcd"]
        rows += [base + [*line, "e"] * 60, base + [*line, "f"] * 60]
    rows = [(i, " ".join(f)) for i, f in enumerate(rows)]
    want = classes(rows)
    assert len(set(want.values())) == 10
    assert got(docs(spark, [(i, t, "s") for i, t in rows])) == want


def test_sketches_of_a_set():
    words = o.mix64(np.arange(300, dtype=np.uint64))
    keys, different = o.bucket_keys(np.concatenate([words, words[:90]]))
    assert different == 300 and set(o.sketches(words)) <= set(keys)


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words), "s"), (2, "an other text of its own with some more words", "s"), (2, " ".join(words[:39]), "s"), (3, "x y z", "s"), (3, "x  y z", "s")]
    got = o.one_of_each(docs(spark, rows))
    assert sorted((r.doc_id, r.text.split()[0]) for r in got.collect()) == [(1, "w0"), (2, "an"), (3, "x")]


def test_alignment_of_long_texts_holds_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    a = rng.permutation(60_000)
    b = np.delete(a, rng.choice(60_000, 5000, replace=False))
    tracemalloc.start()
    assert o.aligned(a, b) and not o.aligned(a, np.concatenate([b[30_000:], b[:30_000]]))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_alignment_equals_the_plain_subsequence(monkeypatch):
    monkeypatch.setattr(o, "OFTEN", 3)
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randint(0, 12) for _ in range(rng.randint(5, 40))]
        b = [x if rng.random() > 0.12 else rng.randint(0, 12) for x in a if rng.random() > 0.08]
        if b:
            want = in_order(a, b) >= o.SIMILARITY - 1e-9
            assert o.aligned(np.array(a), np.array(b)) == want
