"""DuckDB SQL for the queries that SQL can express.

Substring dedup and the embedding join: plain enumerations of what the
operators find by sketch and by hashing.  The others rest on learned models, a
tokenizer, an approximate search or a rule set with suppression; they are
tested against brute force, round trips and held-out labels.
"""

from __future__ import annotations

OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS other FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.id = e.vec_id
"""

OP10 = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, i, list_aggregate(ws[i : i + 19], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM f, (SELECT unnest(range(0, 20)) AS j) WHERE r > 1),
gone2 AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
k AS (
  SELECT w.doc_id, list_aggregate(list(x ORDER BY pos), 'string_agg', ' ') AS kept
  FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM w) w
  LEFT JOIN gone g USING (doc_id, pos) WHERE g.pos IS NULL GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN gone2 g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op7_embed_dedup": OP7, "op10_substring_dedup": OP10}
