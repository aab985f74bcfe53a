"""The queries on repeated bytes, words and lines, near-duplicates and vectors as SQL, for comparison on small tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: Places whose window starts in an earlier place; a place is gone if such a window started at most width - 1 before.
_COVER = """
least AS (SELECT k, min({order}) AS m FROM atoms WHERE k IS NOT NULL GROUP BY k),
marked AS (SELECT atoms.*, coalesce(m < {order}, false) AS hit FROM atoms LEFT JOIN least USING (k)),
last AS (SELECT *, max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS a FROM marked),
covered AS (SELECT *, coalesce(a >= i - {back}, false) AS gone FROM last)"""

BYTES = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, (length(h) / 2)::BIGINT)) AS i FROM h),
atoms AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS k FROM places),
{_COVER.format(order="doc_id", back=49).strip()},
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered),
r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM edged GROUP BY doc_id)
SELECT doc_id, (length(h) / 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN r USING (doc_id)
"""

WORDS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
atoms AS (
  SELECT doc_id, i, ws[i] AS x, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i:i + 12], ' ') END AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
{_COVER.format(order="doc_id", back=12).strip()},
r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM covered GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

#: Runs of 3 lines, and of fewer lines with 13 words, that start in an earlier place.
LINES = rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, p, ls[p] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM l)),
s AS (SELECT doc_id, p, x, len(regexp_extract_all(x, '{WORD}')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM e WHERE regexp_matches(x, '{WORD}')),
t AS (
  SELECT *, x || chr(10) || lead(x) OVER o AS x2, w + lead(w) OVER o AS w2, x || chr(10) || lead(x) OVER o || chr(10) || lead(x, 2) OVER o AS x3
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT doc_id, i, 1 AS n, x AS k FROM t WHERE w >= 13 UNION ALL SELECT doc_id, i, 2, x2 FROM t WHERE w2 >= 13
  UNION ALL SELECT doc_id, i, 3, x3 FROM t WHERE x3 IS NOT NULL),
least AS (SELECT k, min({{'d': doc_id, 'i': i}}) AS m FROM runs GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM runs JOIN least USING (k), range(0, 3) r(o) WHERE m < {{'d': doc_id, 'i': i}} AND o < n),
c AS (SELECT s.*, gone.i IS NOT NULL AS gone FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.i = s.i),
r AS (
  SELECT e.doc_id, count(c.i) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(e.x, chr(10) ORDER BY e.p) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, md5(kept) AS kept_md5 FROM r
"""

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS k
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
root AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root ON a = w.doc_id
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _whole_numbers(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))"


PRODUCTS = f"""
WITH c AS (SELECT vec_id, {_whole_numbers(256)} AS v FROM embeddings WHERE {_WHOLE}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM c JOIN (SELECT DISTINCT vec_id, v FROM c WHERE vec_id % 50 = 0) q ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEGATIVES = f"""
WITH c AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_whole_numbers(256)} AS v
  FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM c JOIN c a ON a.vec_id <> c.vec_id AND a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
f AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM f WHERE rank <= 5
"""


def clusters(k: int = 8, rounds: int = 10) -> str:
    """Every round as two common tables: the nearest centroids, and the means of their vectors."""
    steps = [f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('3:' || vec_id) AS h FROM e ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS best
  FROM e, c{r} GROUP BY vec_id, v)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT c, list(floor_mean ORDER BY i) AS m FROM (
    SELECT best.c AS c, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
    FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN m{r} n ON n.c = o.c)""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {_WHOLE}),
{", ".join(steps)},
t AS (SELECT best.c AS c, sum(best.d)::BIGINT AS inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, t.inertia AS cluster_inertia, (SELECT sum(inertia) FROM t)::BIGINT AS inertia,
       sha256(array_to_string(f.m, ',')) AS centroid_sha256
FROM a{rounds} JOIN t ON t.c = best.c JOIN c{rounds} f ON f.c = best.c
"""
