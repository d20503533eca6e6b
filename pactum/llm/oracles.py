"""What the operators must give, in DuckDB's SQL, where it can say it: plain definitions, without any of the
operators' short cuts."""

from __future__ import annotations

#: Words of a text: A-Z in lower case, cut at the six ASCII white-space characters.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = f"""
WITH RECURSIVE word AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
shingle AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM word
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
),
tie AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM tie UNION SELECT reach.a, tie.b FROM reach JOIN tie ON reach.b = tie.a)
SELECT word.doc_id, coalesce(size.n, 0) AS n_shingles, least(word.doc_id, coalesce(least_of.b, word.doc_id)) AS component_id
FROM word LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) AS least_of USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

#: Windows of 100 bytes as 200 hexadecimal digits; the first of equal ones by document, then by start, stays.
REPEATED_BYTES = """
WITH text AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
span AS (SELECT doc_id, h, strlen(h) // 2 AS n FROM text),
place AS (SELECT doc_id, unnest(range(n - 99)) AS i, h FROM span WHERE n >= 100),
win AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS m FROM place),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
ordered AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM ordered),
gone AS (SELECT doc_id, r, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, r, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY r)),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS h FROM (
    SELECT doc_id, a, b FROM gap UNION ALL SELECT doc_id, max(b), 1000000000 FROM gone GROUP BY doc_id
  ) JOIN span USING (doc_id) GROUP BY doc_id
),
lost AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT span.doc_id, CAST(span.n AS BIGINT) AS n_bytes, CAST(coalesce(lost.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(lost.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, span.h))) AS kept_sha256
FROM span LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
