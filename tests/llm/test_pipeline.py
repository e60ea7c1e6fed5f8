import glob
import os

import corpus_pipeline
import duckdb
import pytest
from cases import SF, docs
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from tracewell.llm import pareto_mix
from tracewell.llm.queries import ORACLES


def test_stages_keep_their_contract(spark, tmp_path):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    rows = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert rows["near_dedup"] < rows["quality"] and rows["secrets"] == rows["near_dedup"]
    assert seen["mixing"].count() == seen["encoding"].count()
    words = seen["secrets"].select("source", pareto_mix.words("text").alias("n")).agg(F.sum("n")).first()[0]
    taken = seen["mixing"].select(pareto_mix.words("text").alias("n")).agg(F.sum("n")).first()[0]
    assert abs(taken - 1.5 * words) < 0.05 * words
    assert seen["secrets"].where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0


def test_run_takes_every_case(spark, tmp_path):
    df = docs(spark, extra=False)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() >= 0
    (tmp_path / "none").mkdir()
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    state, _, _, note = compare(spark, con, name, SF)
    assert state == "ok", note


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
