import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import docs

from tracewell.llm import range_max_search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, k=10):
    """The definition, document by document."""
    found = [(i, Counter(words(t))) for i, t in rows]
    full = [x for x in found if x[1]]
    n, length = len(full), sum(sum(c.values()) for _, c in full)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = {}
    for item, own in asked.items():
        scores = []
        for doc, c in full:
            m = 10 + (90 * sum(c.values()) * n) // length
            score = 0
            for t in own & set(c):
                df = sum(t in x for _, x in full)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out[item] = [(None if null else d, -x) for x, null, d in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r["rank"])):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.mark.parametrize("postings, small", [(1 << 20, 256), (300, 0), (1, 8)])
def test_like_the_definition(spark, monkeypatch, postings, small):
    monkeypatch.setattr(s, "POSTINGS", postings)
    monkeypatch.setattr(s, "SMALL", small)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    rows = [(i // 2 * 3, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 30)))) for i in range(400)]
    rows += [(1000 + i, "w5 W7 w90") for i in range(40)] + [(None, "w5 w7 w90"), (None, "w3"), (7, None), (8, "--- !")]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=8))) for i in range(15)]
    items += [(90, "w5 w90 w90"), (91, None), (92, "absent"), (3, "w100"), (None, "w7 w8")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    want = plain(rows, items)
    assert got(s.search(df, asked)) == want
    if postings > 300:
        assert got(s.search(df, asked, item_bytes=60)) == want  # several groups of items


def test_search_opens_few_intervals_where_few_documents_matter():
    rng = np.random.default_rng(0)
    n = 4000
    doc, term = np.arange(n, dtype=np.int32).repeat(2), np.tile([0, 1], n)
    impact = np.where(rng.random(2 * n) < 0.01, rng.integers(1000, 2000, 2 * n), rng.integers(1, 10, 2 * n))
    block, best, seen = s.Block(np.arange(n), doc, term, impact), s.Best(10), []
    offer, s_sum = best.offer, block._sum
    best.offer = lambda *a: (seen.append(a), offer(*a))
    block._sum = lambda left, right, b: (seen.extend([0] * int((right - left).sum())), s_sum(left, right, b))
    block.search(np.array([0, 1]), best)
    total = impact.reshape(n, 2).sum(axis=1)
    want = sorted(((int(x), -i) for i, x in enumerate(total)), reverse=True)[:10]
    assert sorted(best.heap, reverse=True) == want and len(seen) < n


def test_range_maxima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 300)
    table = s.RangeMax(values, 300)
    left = rng.integers(0, 301, 500)
    right = np.minimum(300, left + rng.integers(0, 301, 500))
    place, value = table(left, right)
    for a, b, p, v in zip(left, right, place, value, strict=True):
        assert (p, v) == (-1, 0) if a == b else values[p] == v == values[a:b].max() and a <= p < b


def test_cases(spark):
    df = docs(spark)
    items = spark.createDataFrame([(1, "Seventeen PASSWORD"), (2, "word 日本"), (3, None)], "item_id long, text string").selectExpr("*", "'x' AS terms", "1 AS n", "2 AS score")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = s.search(df, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(out) == plain(rows, [(r.item_id, r.text) for r in items.collect()])
    assert s.search(df.limit(0), items).count() == 0 and s.search(df, items.limit(0)).count() == 0
