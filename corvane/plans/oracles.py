"""DuckDB SQL of the registered queries."""

from __future__ import annotations

V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS e, label FROM embeddings), p AS (SELECT id AS qid, e AS q FROM v WHERE id % 100 = 0)"
COS = "greatest(-1.0, least(1.0, list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)))))"
SCORE = {"cosine": COS, "dot": "list_inner_product(e, q)", "euclidean": "list_distance(e, q)"}
ORDER = {"cosine": "DESC", "dot": "DESC", "euclidean": "ASC"}


def _scored(metric: str, where: str = "true", extra: str = "") -> str:
    return f"s AS (SELECT v.id, label{extra}, qid, {SCORE[metric]} AS score FROM v, p WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {ORDER[metric]}, id) AS rank FROM s)"


ORACLES: dict[str, str] = {
    "dist_pairwise": f"WITH {V} SELECT id, round({COS}, 6) AS cosine, round(list_inner_product(e, q), 5) AS dot, round(list_distance(e, q), 5) AS l2 FROM v, p WHERE qid = 0",
    "normalize_vectors": f"WITH {V}, u AS (SELECT id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-10)) AS u FROM v) SELECT id, round(list_inner_product(u, u), 6) AS length_squared, round(u[1], 6) AS first FROM u",
    "knn_prefilter": f"WITH {V}, {_scored('cosine', 'qid = 0 AND label IN (1, 2, 3)')} SELECT id, label, round(score, 5) AS score, rank FROM r WHERE rank <= 10",
    "knn_postfilter": f"WITH {V}, {_scored('cosine', 'qid = 0')}, f AS (SELECT * FROM r WHERE rank <= 30 AND label IN (1, 2, 3)), n AS (SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () >= 10 AS is_complete FROM f) SELECT id, label, round(score, 5) AS score, rank, is_complete FROM n WHERE rank <= 10",
    "knn_variant_filter": f"WITH {V}, {_scored('dot', 'qid = 0 AND label >= 2 AND label < 8 AND label % 3 IN (0, 1)')} SELECT id, label, round(score, 5) AS score, rank FROM r WHERE rank <= 10",
    "result_assembly": f"WITH {V}, {_scored('euclidean')} SELECT qid, id, round(score, 5) AS score, rank, '{{\"label\":' || label || '}}' AS metadata FROM r WHERE rank <= 3",
    "recall_at_k": f"WITH {V}, {_scored('euclidean')}, g AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s WHERE id % 4 <> 1) SELECT r.qid, round(sum((g.id IS NOT NULL)::INT) / 10.0, 6) AS recall FROM r LEFT JOIN g ON r.qid = g.qid AND r.id = g.id AND g.rank <= 10 WHERE r.rank <= 10 GROUP BY r.qid",
    "latency_percentiles": "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events",
    "monotonicity_violations": "WITH b AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) SELECT event_id, event_type, round(value, 6) AS value, round(before, 6) AS before FROM b WHERE value < before - 0.01",
    "estimate_memory": "WITH n AS (SELECT unnest([1, 1000, 50000, 1000000])::BIGINT AS n), g AS (SELECT n, CAST(floor(n * 256 * CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 1 + ln(n) / ln(16) END) AS BIGINT) AS graph_bytes, n * 512 AS vector_bytes, n * 200 AS metadata_bytes FROM n) SELECT *, graph_bytes + vector_bytes + metadata_bytes AS total_bytes, round((graph_bytes + vector_bytes + metadata_bytes) / 1048576.0::DOUBLE, 6) AS total_mb FROM g",
    "filter_and": "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 10 AND event_type = 'click'",
    "monotonicity_violations_falling": "WITH b AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) SELECT event_id, event_type, round(value, 6) AS value, round(before, 6) AS before FROM b WHERE value > before + 0.01",
    "query_rates": "WITH r AS (SELECT count(*) / sum(abs(value) + 1) AS rate FROM events GROUP BY event_id % 97) SELECT round(quantile_cont(rate, 0.5), 6) AS median, round(min(rate), 6) AS min, round(max(rate), 6) AS max FROM r",
    "filter_large_numbers": "SELECT event_id FROM events WHERE event_id % 10 BETWEEN 3 AND 5",
    "filter_empty": "SELECT event_id FROM events",
    "filter_missing_field": "SELECT event_id FROM events WHERE false",
    "id_validation": "WITH i AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '/') WHEN 2 THEN repeat('x', c_custkey % 1000) ELSE replace(c_name, '#', ' ') END AS id FROM customer) SELECT c_custkey, CASE WHEN id IS NULL THEN 'null_id' WHEN length(id) = 0 THEN 'empty_id' WHEN length(id) > 512 THEN 'long_id' WHEN regexp_matches(id, '[/ \\t\\n\\r]') THEN 'bad_character' END AS error FROM i",
}

for _m in SCORE:
    ORACLES[f"knn_exact_{_m}"] = f"WITH {V}, {_scored(_m, 'qid = 0')} SELECT id, round(score, 5) AS score, rank FROM r WHERE rank <= 10"
    ORACLES[f"knn_batch_{_m}"] = f"WITH {V}, {_scored(_m)} SELECT qid, id, round(score, 5) AS score, rank FROM r WHERE rank <= 10"

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
ORACLES |= {f"filter_{k}": f"SELECT event_id FROM events WHERE {_K} {c}" for k, c in {"eq": "= 7", "gt": "> 50", "gte": ">= 50", "lt": "< 20", "lte": "<= 20", "in": "IN (1, 5, 9)", "range": "BETWEEN 10 AND 30"}.items()}

# Mixed types: the number and the text that a field has, by the kind of value the event got.
_MIXED = "WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 50)::DOUBLE WHEN 2 THEN event_id % 50 + 0.5 WHEN 3 THEN 1.0 END AS num, CASE WHEN event_id % 6 = 1 THEN CAST(event_id % 50 AS VARCHAR) END AS txt FROM events) SELECT event_id FROM m WHERE "
ORACLES |= {
    "filter_mixed_eq_number": _MIXED + "num = 20", "filter_mixed_eq_string": _MIXED + "txt = '19'", "filter_mixed_gt_number": _MIXED + "num > 30 OR txt IS NOT NULL", "filter_mixed_lt_string": _MIXED + "num IS NOT NULL OR txt < '3'",
    "filter_mixed_true": _MIXED + "num = 1", "filter_mixed_in": _MIXED + "num IN (6, 1) OR txt = '7'",
}

_LOG = (
    V + ", log AS (SELECT id AS seq, 'put' AS op, CAST(id AS VARCHAR) AS id, id AS slot_id, e, label FROM v UNION ALL SELECT 1000000 + id, 'put', CAST(id AS VARCHAR), 1000000 + id, list_transform(e, lambda x: x * -2.0), label FROM v WHERE id % 5 = 3"
    " UNION ALL SELECT 2000000 + id, 'del', CAST(id AS VARCHAR), 2000000 + id, e, label FROM v WHERE id % 10 IN (3, 4) UNION ALL SELECT 3000000 + id, 'put', CAST(id AS VARCHAR), 3000000 + id, list_transform(e, lambda x: x * 0.5), label FROM v WHERE id % 20 = 4)"
    ", live AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM log) WHERE n = 1 AND op = 'put')"
)
ORACLES |= {
    "live_view": f"WITH {_LOG} SELECT id, slot_id, label FROM live",
    "count_live": f"WITH {_LOG} SELECT count(*) AS n FROM live",
    "count_all": f"WITH {_LOG} SELECT count(DISTINCT slot_id) AS n FROM log WHERE op = 'put'",
    "live_ids": f"WITH {_LOG} SELECT id FROM live",
    "get_by_id": f"WITH {_LOG} SELECT id, slot_id, round(e[1], 5) AS first FROM live WHERE id = '8'",
    "max_slot": f"WITH {_LOG} SELECT max(slot_id) + 1 AS next_slot FROM log",
    "tombstoned_slots": f"WITH {_LOG} SELECT DISTINCT slot_id FROM log WHERE op = 'put' AND slot_id NOT IN (SELECT slot_id FROM live)",
    "search_excludes_tombstones": f"WITH {_LOG}, s AS (SELECT id, list_distance(e, q) AS score FROM live, p WHERE qid = 0) SELECT id, round(score, 5) AS score, row_number() OVER (ORDER BY score, id) AS rank FROM s ORDER BY score, id LIMIT 20",
    "update_latest_wins": f"WITH {_LOG} SELECT id, slot_id, round(e[1], 5) AS first FROM live WHERE slot_id >= 1000000 AND slot_id < 2000000",
    "reinsert_after_delete": f"WITH {_LOG} SELECT id, slot_id, round(e[1], 5) AS first FROM live WHERE slot_id >= 3000000",
}

_RECORDS = (
    "r AS (SELECT vec_id AS pos, CASE WHEN vec_id % 11 = 1 THEN 'bad id' WHEN vec_id % 13 = 2 THEN '' WHEN vec_id % 17 = 3 THEN NULL WHEN vec_id % 19 = 4 THEN CAST(vec_id - 1 AS VARCHAR) ELSE CAST(vec_id AS VARCHAR) END AS id,"
    " CASE WHEN vec_id % 23 = 5 THEN 'wrong_dimension' WHEN vec_id % 29 = 6 THEN 'nan_element' WHEN vec_id % 31 = 7 THEN 'null_vector' END AS bad_vector, CASE WHEN vec_id % 37 = 8 THEN 'metadata_not_an_object' WHEN vec_id % 41 = 9 THEN 'malformed_metadata' END AS bad_metadata FROM embeddings),"
    " b AS (SELECT *, coalesce(CASE WHEN id IS NULL THEN 'null_id' WHEN id = '' THEN 'empty_id' WHEN id = 'bad id' THEN 'bad_character' END, bad_vector, bad_metadata) AS bad FROM r),"
    " l AS (SELECT CAST(range * 7 AS VARCHAR) AS live FROM range(50)),"
    " c AS (SELECT pos, coalesce(bad, CASE WHEN live IS NOT NULL THEN 'duplicate_id' WHEN row_number() OVER (PARTITION BY id, bad IS NULL ORDER BY pos) > 1 THEN 'duplicate_id' END) AS error FROM b LEFT JOIN l ON id = live)"
)
ORACLES |= {
    "batch_insert_errors": f"WITH {_RECORDS} SELECT pos, error FROM c",
    "batch_insert_report": f"WITH {_RECORDS} SELECT sum((error IS NULL)::BIGINT)::BIGINT AS inserted, sum((error IS NOT NULL)::BIGINT)::BIGINT AS failed FROM c",
}

_LAYER = "y AS (SELECT vec_id AS id, CAST(floor(-ln(greatest((vec_id * 7919 % 10007 + 1) / 10008.0::DOUBLE, 1e-10)) / ln(4.0::DOUBLE)) AS INT) AS layer FROM embeddings)"
_CAND = f"{V}, {_scored('euclidean')}, k AS (SELECT qid AS node, id AS other, score AS distance FROM r WHERE rank <= 30 AND id <> qid), c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, other) AS rank FROM k), e AS (SELECT node, other, distance, rank FROM c WHERE rank <= 8)"
ORACLES |= {
    "layer_assignment": f"WITH {_LAYER} SELECT id, layer FROM y",
    "layer_histogram": f"WITH {_LAYER} SELECT layer, count(*) AS n FROM y GROUP BY layer",
    "entry_point_recovery": f"WITH {_LAYER} SELECT id AS node, layer FROM y WHERE id % 3 <> 0 ORDER BY layer DESC, id LIMIT 1",
    "select_neighbors_simple": f"WITH {_CAND} SELECT node, other, round(distance, 5) AS distance, rank FROM e",
    "graph_integrity": f"WITH {_CAND}, a AS (SELECT node, other FROM e UNION SELECT other, node FROM e WHERE other % 2 = 0), n AS (SELECT id FROM v WHERE id % 9 <> 5) SELECT 'degree' AS problem, node, NULL::BIGINT AS other FROM a GROUP BY node HAVING count(*) > 7 UNION ALL SELECT 'missing', node, other FROM a WHERE other NOT IN (SELECT id FROM n) UNION ALL SELECT 'one_way', node, other FROM a WHERE NOT EXISTS (SELECT 1 FROM a AS z WHERE z.node = a.other AND z.other = a.node)",
}

# The full query set for the filtered searches, and every row as a node.
_TOP = "SELECT qid, id, round(score, 5) AS score, rank FROM r WHERE rank <= "
_EVERY = _CAND.replace(" WHERE id % 100 = 0)", ")")
ORACLES |= {
    "knn_prefilter_batch": f"WITH {V}, {_scored('cosine', 'label IN (1, 2, 3)')} {_TOP} 10",
    "knn_postfilter_batch": f"WITH {V}, {_scored('cosine')}, f AS (SELECT * FROM r WHERE rank <= 30 AND label IN (1, 2, 3)), n AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY qid) >= 10 AS is_complete FROM f) SELECT qid, id, round(score, 5) AS score, rank, is_complete FROM n WHERE rank <= 10",
    "knn_variant_filter_batch": f"WITH {V}, {_scored('dot', 'label >= 2 AND label < 8 AND label % 3 IN (0, 1)')} {_TOP} 10",
    "search_excludes_tombstones_batch": f"WITH {_LOG}, s AS (SELECT qid, id, list_distance(e, q) AS score FROM live, p), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s) {_TOP} 20",
    "select_neighbors_simple_all": f"WITH {_EVERY} SELECT node, other, round(distance, 5) AS distance, rank FROM e",
}
