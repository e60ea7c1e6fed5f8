import zlib

import numpy as np
import pytest
from cases import docs
from pyspark.sql import functions as F

from tracewell.llm import quality, splits, toxicity
from tracewell.llm.classifier_queries import quality_query, toxicity_query

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "folds", "fold", "least"), [(toxicity_query, "toxic", 5, 0, 0.9), (quality_query, "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, query, label, folds, fold, least):
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and truth.get(r.doc_id) is not None:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) >= least


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_toxicity_cases(spark):
    df = docs(spark)
    marks = labels(spark, [(1, 0, 1), (2, 0, 1), (3, 1, 0), (6, 1, 0), (7, None, None), (8, 2, 2), (None, 1, 1)])
    model = toxicity.fit(splits.labelled(df, marks, "toxic", 5, 0))
    assert toxicity.score(df, model).count() == df.count()
    none = toxicity.fit(splits.labelled(df, marks.limit(0), "toxic", 5, 0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_grams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(4000))
    whole = np.sort(toxicity.Grams()(text))
    monkeypatch.setattr(toxicity, "PIECE", 257)
    assert np.array_equal(np.unique(toxicity.Grams()(text)), whole)
    assert len(whole) == len(np.unique(whole))


def test_toxicity_learns_words(spark):
    rows = [(i, f"plain words number {i * 7919 % 1000} here" + (" you blorp" if i % 4 == 0 else ""), "s") for i in range(400)]
    df = docs(spark, rows)
    model = toxicity.fit(splits.labelled(df, labels(spark, [(i, int(i % 4 == 0), 1) for i in range(400)]), "toxic", 5, 0))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in got)


def test_quality_cases(spark):
    df = docs(spark)
    featured = quality.features(df)
    assert featured.count() == df.count()
    marks = splits.marks(labels(spark, [(1, 0, 1), (2, 0, 1), (3, 0, 0), (6, 1, 0), (7, 1, 0), (8, None, None)]), "quality", 3, 1)
    model = quality.fit(featured.join(marks, F.col("key") == F.col("doc_id")))
    assert quality.score(featured, model).count() == df.count()
    kept = quality.keep(df, model)
    assert kept.columns == df.columns
    scores = {str(r.key): r.score for r in quality.score(featured, model).collect()}
    assert {str(r.doc_id) for r in kept.collect()} == {k for k, v in scores.items() if v >= 0.5}
    one_class = quality.fit(featured.select(F.lit(1).alias("label"), "x"))
    share = (df.count() + 1) / (df.count() + 2)
    assert all(abs(r.score - share) < 1e-12 for r in quality.score(featured, one_class).collect())
    assert quality.score(quality.features(df.limit(0)), model).count() == 0


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    model = quality.Model(np.zeros(d), np.ones(d), np.zeros((2, d)), np.array([np.eye(d), 0.5 * np.eye(d)]), np.array([0.0, 2 * d * np.log(2)]), 0.3)
    x = rng.normal(size=(5, d))
    square = (x**2).sum(1)
    want = (-square / 8 - d * np.log(2)) - (-square / 2) + 0.3
    assert np.allclose(model.log_odds_of(x), want)
