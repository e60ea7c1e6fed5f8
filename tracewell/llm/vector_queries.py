"""Queries of the operators on vectors."""

from __future__ import annotations

from tracewell.llm import ann_tree, metric_join
from tracewell.llm.registry import query, table


@query("op2_ann_tree")
def ann_tree_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_tree.search(rows, "vec_id % 20 = 0", k=20).result


@query("op10_metric_join")
def metric_join_query(spark, sf_dir):
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
