"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '{_WORDS}') END AS w FROM documents),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
x AS (SELECT DISTINCT doc_id, i + j AS p FROM n, unnest(range(20)) AS t(j) WHERE n > 1),
r AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256 FROM k""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
m AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN m AS x ON x.doc_id = a JOIN m AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN m USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL""",
}
