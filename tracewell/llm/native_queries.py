"""Queries of the operators that need nothing but DataFrame expressions: secrets, shards, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm import pareto_mix, secret_scan, slots
from tracewell.llm.registry import query, table
from tracewell.session import new_work_path


def _kind_sql(rank: int, rule: secret_scan.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.name}' AS kind,
         unnest(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
           finish := list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))),
           hit := hits[i], value := vals[i]))) AS m
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, string_split_regex(t, '{pattern}') AS gaps,
               regexp_extract_all(t, '{pattern}', {rule.group}) AS vals FROM texts WHERE regexp_matches(t, '{pattern}'))"""


SECRETS_SQL = (
    "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), each AS ("
    + "\n  UNION ALL".join(_kind_sql(i, r) for i, r in enumerate(secret_scan.BASE_RULES))
    + """
), spans AS (
  SELECT doc_id, rank, kind, CAST(m.finish - length(m.hit) AS BIGINT) AS a, CAST(m.finish AS BIGINT) AS b
  FROM each WHERE kind <> 'assign' OR length(m.value) >= 6
), found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (doc_id)
"""
)


@query("op1_secret_scans", SECRETS_SQL)
def secret_scans(spark, sf_dir):
    ledger = new_work_path(spark, "secret-ledger")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, ledger)
    spans = F.col("spans")
    base = [r.name for r in secret_scan.BASE_RULES]
    base_spans = F.filter(spans, lambda s: s["kind"].isin(base))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(secret_scan.count_kind(spans, kind).alias(f"n_{kind}") for kind in base),
        F.sha2(secret_scan.spans_text(base_spans), 256).alias("base_sha256"),
        secret_scan.spans_text(spans).alias("spans"),
    )


@query("op4_virtual_slots")
def virtual_slots(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    records = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = slots.shard_by_stored_map(records, 24, "size", ["doc_id", "text_crc32"], new_work_path(spark, "slot-map"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


MIX_SQL = """
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         (CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w,
         source_size::DOUBLE * 2.0::DOUBLE AS cap
  FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER ahead, 0.0::DOUBLE))
              / (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0.0::DOUBLE)) AS level
  FROM ranked
  WINDOW ahead AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen_level AS (
  SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, source IS NULL, source LIMIT 1
), goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM (SELECT source, source_size, least(cap, coalesce((SELECT level FROM chosen_level) * w, cap)) AS target FROM levels)
), parts AS (
  SELECT source, source_size, target, CAST(floor(rate) AS INTEGER) AS whole, rate - floor(rate) AS part,
         target - floor(rate) * source_size AS wanted
  FROM goal
), queue AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.wanted, d.size > 0 AND g.part > 0 AS can,
         (d.u / (1 - d.u)) * ((1 - p) / p) AS q
  FROM docs d JOIN (SELECT *, least(greatest(part, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p FROM parts) g
    ON d.source IS NOT DISTINCT FROM g.source
), taken AS (
  SELECT *, CASE WHEN can AND sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING)
                          - size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END AS extra
  FROM queue
), gaps AS (
  SELECT *, wanted - sum(size * extra) OVER (PARTITION BY source) AS gap FROM taken
), offers AS (
  SELECT *, abs(gap - CASE WHEN extra = 1 THEN -size ELSE size END) AS after FROM gaps
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY source, can AND after < abs(gap) ORDER BY after, q, doc_id) = 1
              AND can AND after < abs(gap) AS flip
  FROM offers
)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (whole + CASE WHEN flip THEN 1 - extra ELSE extra END) AS BIGINT) AS taken
FROM steps
"""


@query("op7_pareto_mix", MIX_SQL)
def pareto_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", pareto_mix.words("text").alias("size"))
    mixed = pareto_mix.mix(docs)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
