"""A corpus pipeline of five operators, each stage on all rows that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Every stage is written as Parquet
and read again as the documents of the next. All but the last return the columns of ``documents``:

1. quality: documents that the discriminant rejects go (score below 0.5);
2. near_dedup: of each class of near duplicates the document with the least id stays;
3. secrets: texts stay, each run of found secrets is replaced by a mark;
4. mixing: documents are repeated or left out, so that sources reach their target words;
5. encoding: doc_id, n_tokens, token ids, and the hash of the decoded bytes.

Defined results: null texts are handled as empty ones by every stage and stay null where they are kept; repeated rows count each in
stages 1, 3, 4 and 5 and become one in stage 2; extra columns pass through stages 1 to 4 untouched, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe_replay, order_minhash, pareto_mix, quality, secret_scan, splits
from tracewell.session import new_work_path, write_and_read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts. It learns from labelled rows of these documents."""
    marks = splits.marks(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 3, 1)
    model = quality.fit(quality.features(docs).join(marks, F.col("key") == F.col("doc_id")))
    return quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, new_work_path(spark, "secret-ledger"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pareto_mix.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe_replay.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # Executors still hold the memory of four stages: smaller blocks of words than alone.
    both = bpe_replay.encode(
        docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, and_decode=True, keep_words=40_000, replay_bytes=2_000_000
    )
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Sketches, trained scores and merges are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), new_work_path(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
