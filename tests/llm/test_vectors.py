import numpy as np
from cases import vectors

from tracewell.llm import ann_tree, metric_join

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [NAN] * 8, 1), (904, [INF] * 8, 1), (905, [1.0, 2.0], 1),
       (None, [1.0] * 8, 1)]


def clustered(n=600, d=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.12, size=(n, d))
    x[50:60] = x[50]  # ties
    return [(i, [float(np.float32(v)) for v in row], int(i % 3)) for i, row in enumerate(x)]


def test_search_finds_the_nearest(spark):
    rows = clustered()
    found = ann_tree.search(vectors(spark, rows + ODD), "vec_id % 20 = 0", k=20)
    x = np.array([r[1] for r in rows])
    recall = []
    by_query = {}
    for r in found.result.collect():
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by_query) == {i for i in range(0, 600, 20)}
    for q, got in by_query.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        for _, v, s in got:
            assert abs(s - x[q] @ x[v]) < 1e-12
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len({g[1] for g in got} & set(np.lexsort((np.arange(600), -score))[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_search_on_documents_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = ann_tree.search(df, "vec_id % 20 = 0")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    got = {}
    for r in found.result.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        recall.append(len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_search_visits_few_of_many_leaves(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 16), ("CHUNK", 300), ("QUERY_CHUNK", 30), ("MERGE_BYTES", 400_000)):
        monkeypatch.setattr(ann_tree, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 8))
    x = centres[rng.integers(0, 150, 5000)] + rng.normal(scale=0.1, size=(5000, 8))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    found = ann_tree.search(vectors(spark, [(i, row.tolist(), 0) for i, row in enumerate(x)]), "vec_id % 20 = 0", k=10)
    assert found.leaves > 200 and found.visits < found.leaves / 4
    x, got, recall = x.astype(np.float32).astype(float), {}, []
    for r in found.result.collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 5000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(set(got[q]) & set(np.argsort(-score)[:10].tolist())) / 10)
        assert len(got[q]) == 10
    assert len(got) == 250 and np.mean(recall) >= 0.9


def test_search_cases(spark):
    few = [(0, [1.0] * 8, 1), (20, [2.0] * 8, 1), (3, [0.5] * 8, 1), (3, [0.5] * 8, 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann_tree.search(vectors(spark, few + ODD), "vec_id % 20 = 0").result.collect())
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert ann_tree.search(vectors(spark, ODD), "vec_id % 20 = 0").result.count() == 0
    assert ann_tree.search(vectors(spark, ODD).limit(0), "vec_id % 20 = 0").result.count() == 0
    same = [(i, [1.0] * 8, 1) for i in range(400)]
    got = ann_tree.search(vectors(spark, same), "vec_id = 0").result.collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21))


def test_search_fills_up_from_an_outlier_leaf(spark, monkeypatch):
    rng = np.random.default_rng(2)

    def a_leaf_for_each_axis(sample, norm, leaves):
        tree = ann_tree.Tree(norm, children=[list(range(1, 9))] + [[]] * 8, leaf=[-1, *range(8)], leaves=8)
        tree.centres = [np.zeros(9), *tree.lift(np.eye(8))]
        return tree

    monkeypatch.setattr(ann_tree, "grow", a_leaf_for_each_axis)
    centre = np.eye(8)[np.repeat(np.arange(7), 100)]
    x = np.concatenate([centre + rng.normal(scale=0.01, size=centre.shape), [[0] * 7 + [1.0]] * 3])
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    found = ann_tree.search(vectors(spark, rows), "vec_id % 20 = 0 AND vec_id < 700 OR vec_id = 702")
    assert found.visits == 1
    got = {}
    for r in found.result.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 36 and {len(v) for v in got.values()} == {20} and {700, 701} <= got[702]


def brute_links(rows, c=0.98):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) == 8
            and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = np.array([r[1] for r in good])
    norm = np.sqrt((x * x).sum(1))
    cosine = (x @ x.T) / np.outer(norm, norm)
    label = np.array([r[2] for r in good])
    linked = (cosine >= c) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = [r[0] for r in good]
    while True:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(good))]
        if new == root:
            break
        root = new
    out = [(r[0], int(n), t) for r, n, t in zip(good, linked.sum(1), root, strict=True)]
    return sorted(map(str, out + [(r[0], 0, r[0]) for r in rows if r not in good]))


def links(df):
    rows = metric_join.near_vectors(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(str((r.vec_id, r.n_links, r.component_id)) for r in rows)


def test_join_like_all_pairs(spark, monkeypatch):
    rows = clustered()
    scaled = [(700 + i, [2 * v for v in rows[i][1]], rows[i][2]) for i in range(20)]
    rows = rows + scaled + ODD + [(950, rows[3][1], None), (951, rows[3][1], 7)]
    monkeypatch.setattr(metric_join, "BLOCK", 25)
    monkeypatch.setattr(metric_join, "PIVOT_ROWS", 20)
    assert links(vectors(spark, rows)) == brute_links(rows)


def test_join_cases(spark):
    rows = [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [3.0] * 8, 1), (3, [1.0] * 8, 2), *ODD]
    assert links(vectors(spark, rows)) == sorted(map(str, [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), *((r[0], 0, r[0]) for r in ODD)]))
    assert links(vectors(spark, rows).limit(0)) == []
    assert links(vectors(spark, ODD[:2])) == sorted(map(str, [(900, 0, 900), (901, 0, 901)]))
