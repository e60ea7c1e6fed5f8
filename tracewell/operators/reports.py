"""Texts built from data: alert digest, statement fingerprints, script batches, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.masking import go_batches, masked

def alert_digest(log: DataFrame, n: int = 3, separator: str = "<br>", tie: str | None = None) -> DataFrame:
    """The last ``n`` log messages, newest first, in one text. ``n`` bounds what is gathered."""
    order = [F.desc("msg_date")] + ([F.desc(tie)] if tie else [])
    last = log.orderBy(*order).limit(n)
    aged = last.withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    return aged.agg(F.expr(f"listagg(msg, '{separator}') WITHIN GROUP (ORDER BY __rank)").alias("digest"))


def statement_fingerprints(audit: DataFrame, text: str = "statement") -> DataFrame:
    """Statements alike but for literals and comments, with count, CPU and duration.

    Equal texts are summed before they reach Python, and the sums again by masked text.
    """
    sums = [F.sum(c).alias(c) for c in ("executions", "cpu_time", "dur_micro_sec")]
    per_text = audit.groupBy(text).agg(
        F.count(F.lit(1)).alias("executions"),
        F.sum("cpu_time").alias("cpu_time"),
        F.sum("dur_micro_sec").alias("dur_micro_sec"),
    )
    return per_text.withColumn("fingerprint", masked(text)).groupBy("fingerprint").agg(*sums)


def split_batches(scripts: DataFrame, key: str, text: str = "script") -> DataFrame:
    """Batches of each script: cut at lines that hold only GO, outside of literals and comments.

    ``--GO`` lines cut the script into chunks first; ``--GO E-`` mutes errors from the chunk that it ends on and
    ``--GO E+`` reports them again. A later chunk begins with the break of the line that cut it off. Lines end in CRLF or LF; a batch keeps the breaks between its own lines. Cuts are
    line numbers, so no character of a script has a meaning of its own.
    """
    marks = F.regexp_extract_all(text, F.lit(_MARK), F.lit(0))
    cut = scripts.where(F.col(text).isNotNull()).select(key, F.split(text, _MARK).alias("texts"), marks.alias("marks"))
    # Each chunk gets its text and its switch before it becomes a row of its own: rows carry nothing of the rest of the script.
    # The last chunk has no mark: its switch is that of the mark before it.
    states = F.split(_filled(F.concat(F.array_join(F.transform("marks", _switch), ""), F.lit(" "))), "")
    chunks = F.zip_with(
        F.transform("texts", _chunk), states, lambda c, state: F.struct(c["no"].alias("no"), c["text"].alias("text"), (state == "-").alias("muted"))
    )
    chunked = cut.select(key, F.explode(chunks).alias("c")).where("c.no IS NOT NULL").select(
        key, F.col("c.no").alias("chunk_no"), F.coalesce("c.muted", F.lit(False)).alias("errors_muted"), F.col("c.text").alias("chunk")
    )
    return chunked.select(key, "chunk_no", "errors_muted", F.posexplode(go_batches("chunk")).alias("batch_no", "batch"))


#: A line that begins with --GO, with the break before it and without its own.
_MARK = r"(?:\A|\r?\n)--[Gg][Oo][^\n]*?(?=\r?\n|\z)"


def _chunk(text: Column, i: Column) -> Column:
    """Number and text of a chunk. Two marks in turn share a break, which is the text of the chunk between them."""
    shared = F.regexp_extract(F.get("marks", i), r"\A(\r?\n)", 1)
    return F.struct(i.alias("no"), F.when((i > 0) & (text == ""), F.coalesce(shared, F.lit(""))).otherwise(text).alias("text"))


def _switch(mark: Column) -> Column:
    """+ or - where a mark switches the reporting of errors, else a blank."""
    sign = F.regexp_extract(mark, r"\A(?:\r?\n)?--[Gg][Oo] [Ee]([+-])", 1)
    return F.when(sign != "", sign).otherwise(F.lit(" "))


def _filled(signs: Column) -> Column:
    """Each blank as the sign before it, in one pass over runs of a sign and its blanks."""
    parts = F.regexp_extract_all(signs, F.lit("[+-] *|^ +"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.repeat(F.substring(p, 1, 1), F.char_length(p))), "")


def sample_rows(df: DataFrame, key: str, fraction: float, first: int, required: str) -> DataFrame:
    """A repeatable sample by hash of ``key``; of it the first rows by key with ``required`` set, numbered."""
    edge = format(min(int(fraction * 16**8), 16**8 - 1), "08x")
    sampled = df.where(F.substring(F.md5(F.col(key).cast("string")), 1, 8) < edge)
    head = sampled.where(F.col(required).isNotNull()).select(key, required).orderBy(key).limit(first)
    return head.withColumn("seq", F.row_number().over(Window.orderBy(key)))
