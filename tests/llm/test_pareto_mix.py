from cases import docs
from pyspark.sql import functions as F

from tracewell.llm import pareto_mix as m


def sized(df):
    return df.withColumn("size", m.words("text"))


def test_targets_share_and_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 300), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in m.targets(sizes).collect()}
    # Weights 3, 1, 2, 3; a and c stop at twice their size, b takes the rest; the last source is empty.
    assert got == {"a": 20.0, "b": 1965.0 - 620.0, "c": 600.0, None: 0.0}


def test_cases(spark):
    df = docs(spark)
    out = m.mix(sized(df))
    rows = out.collect()
    assert len(rows) == df.count()
    assert all(r.copies * r.size <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, m.mix(sized(df)).collect()))
    assert m.mix(sized(df.limit(0))).count() == 0
    assert m.mix(sized(docs(spark, [(1, None, "a"), (2, "", "b")]))).agg(F.sum("copies")).first()[0] == 0


def test_words_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 60), f"s{i % 3}") for i in range(900)]
    got = m.mix(sized(docs(spark, rows))).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")
    )
    assert all(abs(r.taken - r.target) <= 1 for r in got.collect())


def test_tilt_changes_inclusion(spark):
    rows = [(i, "w " * 10, "s") for i in range(2000)]
    df = sized(docs(spark, rows)).withColumn("tilt", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.25))
    got = m.mix(df, tilt_col="tilt").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c"))
    even, odd = (r.c for r in got.orderBy("odd").collect())
    assert even > odd + 0.3 and abs(even + odd - 3.0) < 0.01


def test_repeat(spark):
    df = docs(spark)
    out = m.repeat(df)
    assert out.columns == df.columns
    copies = {}
    for r in m.mix(sized(df)).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in copies.items() if v}
