import random
import re

from cases import docs

from tracewell.llm import window_dedup as w


def brute(rows, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, own in words:
        for j in range(len(own) - k + 1):
            if i is not None:
                first[tuple(own[j : j + k])] = min(i, first.get(tuple(own[j : j + k]), i))
    out = []
    for i, own in words:
        gone = [False] * len(own)
        for j in range(len(own) - k + 1):
            if i is not None and first[tuple(own[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((str(i), len(own), sum(gone), " ".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return sorted(out)


def got(df, **options):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in w.remove_repeats(df, **options).collect())


def test_like_plain_search(spark):
    rng = random.Random(2)
    passages = [[str(rng.randint(0, 30)) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [str(rng.random()) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, 10**12), rng.choice([" ", "\n", "\x0b ", "\t"]).join(words)))
    df = docs(spark, [(i, t, "s") for i, t in rows]).repartition(7)
    assert got(df) == brute(rows)
    assert got(df, k=3) == brute(rows, k=3)


def test_cases(spark):
    df = docs(spark)
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df.limit(0)) == []


def test_small_blocks(spark, monkeypatch):
    rows = [(i, " ".join(str(x % 40) for x in range(i % 50, i % 50 + 60))) for i in range(60)]
    held = [(i, 0, w.Rolling(13)(w.WordHashes().of(t.encode().split()))) for i, t in rows]
    part = w._block(list(held[:30]), 64).to_pandas(), w._block(list(held[30:]), 64).to_pandas()
    import pandas as pd

    places = {}
    for _, group in pd.concat(part).groupby("part"):
        for r in w._repeats(group).itertuples():
            places.setdefault(r.doc_id, set()).update(w.unpack(r.places, "uint32").tolist())
    want = {}
    first = {}
    for i, t in rows:
        own = t.split()
        for j in range(len(own) - 12):
            if first.setdefault(tuple(own[j : j + 13]), i) < i:
                want.setdefault(i, set()).add(j)
    assert places == want
