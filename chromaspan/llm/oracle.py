"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Near-duplicates by shingle sets and label propagation to the smallest id: exact, for small tables.
OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS h FROM s),
r AS (SELECT h, n, min(doc_id) AS rep FROM u WHERE n > 0 GROUP BY h, n),
e AS (SELECT r.rep, r.n, unnest(s.g) AS t FROM r JOIN s ON s.doc_id = r.rep),
p AS (SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
c(a, b) AS (SELECT rep, rep FROM r UNION SELECT c.a, l.y FROM c JOIN l ON c.b = l.x),
k AS (SELECT a, min(b) AS m FROM c GROUP BY a)
SELECT u.doc_id, CAST(u.n AS BIGINT) AS n_shingles, CASE WHEN u.n = 0 THEN u.doc_id ELSE k.m END AS component_id,
  u.doc_id = CASE WHEN u.n = 0 THEN u.doc_id ELSE k.m END AS kept
FROM u LEFT JOIN r ON u.h = r.h AND u.n = r.n LEFT JOIN k ON k.a = r.rep
"""

ORACLES = {"op7_minhash_groups": OP7}
