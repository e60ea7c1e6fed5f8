"""Queries of the operators on words and tokens: byte-level BPE, repeated passages, near duplicates, token counts, ranked search."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tracewell.llm import bpe_replay, order_minhash, piece_counts, range_max_search, window_dedup
from tracewell.llm.registry import query, table


@query("op9_window_dedup")
def window_dedup_query(spark, sf_dir):
    done = window_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op3_bpe_replay")
def bpe_replay_query(spark, sf_dir):
    ranks = bpe_replay.read_ranks(spark, RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_replay.encode(docs, ranks, public_tokenizers.PATTERN, and_decode=True)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_order_minhash")
def order_minhash_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.near_duplicates(docs).select("doc_id", "class_id", "kept")


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op11_piece_counts")
def piece_counts_query(spark, sf_dir):
    return piece_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL)


_TERMS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
SEARCH_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents
), totals AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark)
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, totals GROUP BY term
), norms AS (
  SELECT r, doc_id, 10 + (90 * len(terms) * n_docs) // n_terms AS m FROM docs, totals WHERE len(terms) > 0
), impacts AS (
  SELECT term, r, doc_id, CAST(w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS BIGINT) AS impact
  FROM postings JOIN weights USING (term) JOIN norms USING (r)
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op12_range_max_search", SEARCH_SQL)
def range_max_search_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return range_max_search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
