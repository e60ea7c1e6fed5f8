"""Queries of the two classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm import quality, splits, toxicity
from tracewell.llm.registry import query, table
from tracewell.session import materialise


def _result(scored, folds, fold):
    return scored.select(
        "doc_id",
        splits.held_out("doc_id", folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op6_toxicity")
def toxicity_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(splits.labelled(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0))
    return _result(toxicity.score(docs, model), 5, 0)


@query("op8_quality")
def quality_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    featured = materialise(quality.features(docs), "quality-features")
    marks = splits.marks(table(spark, sf_dir, "labels"), "quality", 3, 1)
    model = quality.fit(featured.join(marks, F.col("key") == F.col("doc_id")))
    return _result(quality.score(featured, model).withColumnRenamed("key", "doc_id"), 3, 1)
