"""DuckDB statements that need more than a few lines."""

from __future__ import annotations

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round stated as an assignment of all parts to all entries and a new codebook."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, label, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far, any_value(x) AS x
  FROM (SELECT p.vec_id, p.label, p.part, p.x, b.entry,
          CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.y[i]) * (p.x[i] - b.y[i]))) AS BIGINT) AS far
        FROM cut p JOIN book{r} b USING (part))
  GROUP BY vec_id, label, part
)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
  SELECT part, entry, i, CAST((s - (((s % n) + n) % n)) // n AS BIGINT) AS y
  FROM (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
        FROM near{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i)
        GROUP BY part, entry, i)
), book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.y, b.y) AS y
  FROM book{r} b LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS y FROM mean{r} GROUP BY part, entry) m USING (part, entry)
)""")
    return f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {FINITE}
), cut AS MATERIALIZED (
  SELECT vec_id, label, p AS part, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x
  FROM whole, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y
  FROM cut WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT {entries})
),{",".join(steps)},
digest AS (
  SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM (SELECT part, entry, array_to_string(y, ',') AS t FROM book{rounds})
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


NEGATIVES_SQL = f"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * v.x[i])) AS BIGINT) AS score
  FROM whole a JOIN whole v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""

LINES_SQL = """
WITH lines AS MATERIALIZED (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line,
    list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: translate(
      trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS key
  FROM documents
), repeated AS MATERIALIZED (
  SELECT list(key) AS keys FROM (
    SELECT key FROM (SELECT DISTINCT doc_id, unnest(key) AS key FROM lines) WHERE key <> '' GROUP BY key HAVING count(*) >= 10
  )
), kept AS (
  SELECT doc_id, len(line) AS n_lines,
    list_transform(list_filter(list_zip(line, key), lambda p: NOT list_contains(coalesce(keys, []), p[2])), lambda p: p[1]) AS line
  FROM lines, repeated
)
SELECT doc_id, n_lines, n_lines - len(line) AS n_dropped, sha256(coalesce(array_to_string(line, chr(10)), '')) AS kept_sha256
FROM kept
"""
