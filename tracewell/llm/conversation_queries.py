"""Queries of the operators on conversations."""

from __future__ import annotations

from tracewell.llm import prefix_trie
from tracewell.llm.registry import query, table

#: CRC-32 of the decimal id, bit by bit: 8 steps after each byte.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda ch: list_prepend(ascii(ch)::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT)"""

TRIE_SQL = f"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, substr(sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest, words) AS ds, list(words ORDER BY turn NULLS FIRST, digest, words) AS ws
  FROM turns GROUP BY conv_id
), cut AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({_CRC} % 4 AS BIGINT) AS h, ds, ws FROM own
), rebuilt AS (
  SELECT c.conv_id, coalesce(b.ds, [])[1:c.h] || c.ds[c.h + 1:] AS ds, coalesce(b.ws, [])[1:c.h] || c.ws[c.h + 1:] AS ws
  FROM cut c LEFT JOIN own b ON b.conv_id = c.base
), places AS (
  SELECT conv_id, unnest(range(0, len(ds) + 1)) AS depth, ds, ws FROM rebuilt
), members AS (
  SELECT conv_id, depth, array_to_string(ds[1:depth], '') AS path, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS words, len(ds) = depth AS ends FROM places
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), family AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND substr(n.path, 1, 32 * p.depth) = p.path
), kids AS (
  SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), above AS (
  SELECT substr(path, 1, 32 * d) AS path, (n_convs - 1) * words AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
  FROM (SELECT n.*, k.n_children, unnest(range(0, depth + 1)) AS d FROM nodes n LEFT JOIN kids k USING (path))
), sums AS (
  SELECT path, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM above GROUP BY path
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM family LEFT JOIN kids USING (path) JOIN sums USING (path)
"""


@query("op13_prefix_trie", TRIE_SQL)
def prefix_trie_query(spark, sf_dir):
    seqs = prefix_trie.share_heads(prefix_trie.sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(seqs)
