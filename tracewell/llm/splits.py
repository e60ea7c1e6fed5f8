"""Labelled rows and the split by which a row may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.membership import bit_of, bitmap, rows_in


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id's decimal text leaves ``fold``; a null id is held out."""
    digits = F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")
    return F.coalesce(F.crc32(digits.cast("binary")) % folds == fold, F.lit(True))


def marks(labels: DataFrame, label_col: str, folds: int, fold: int) -> DataFrame:
    """doc_id, label of what may be learnt from: labelled 0 or 1 and not held out."""
    rows = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    return rows.where(~held_out("doc_id", folds, fold))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int) -> DataFrame:
    """doc_id, body, label of the documents that may be learnt from.

    A bitmap of fixed size keeps most texts without a label out of the shuffle of the join.
    """
    known = marks(labels, label_col, folds, fold)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"), bit_of("doc_id").alias("bit"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    near = rows.mapInArrow(rows_in(bitmap(known, "doc_id")), f"doc_id {kind}, body string, bit int")
    return near.drop("bit").join(known.hint("merge"), "doc_id")
