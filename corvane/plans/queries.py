"""Registered queries of the vector engine over the test tables.

The vectors of ``embeddings`` all have length one; they are scaled by 1 + vec_id % 7 here, so that the
three metrics rank differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.filters import parse_filter
from corvane.functions.metrics import HIGHER, cosine, dot, euclidean, normalized
from corvane.functions.validate import id_error
from corvane.operators import ann, evaluate, knn, oplog

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("embedding"), "label")


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id = 0").select(F.col("embedding").alias("q"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))


@query
def dist_pairwise(spark, sf_dir):
    rows, q = vectors(spark, sf_dir), probe(spark, sf_dir)
    both = rows.crossJoin(F.broadcast(q))
    return both.select("id", F.round(cosine("embedding", "q"), 6).alias("cosine"), F.round(dot("embedding", "q"), 5).alias("dot"), F.round(euclidean("embedding", "q"), 5).alias("l2"))


@query
def normalize_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("u", normalized("embedding"))
    return rows.select("id", F.round(dot("u", "u"), 6).alias("length_squared"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def _exact(metric):
    def run(spark, sf_dir):
        found = knn.search(vectors(spark, sf_dir), probe(spark, sf_dir), 10, metric)
        return found.select("id", F.round("score", 5).alias("score"), "rank")

    return run


def _batch(metric):
    def run(spark, sf_dir):
        found = knn.batch(vectors(spark, sf_dir), probes(spark, sf_dir), 10, metric)
        return found.select("qid", "id", F.round("score", 5).alias("score"), "rank")

    return run


for _m in HIGHER:
    QUERIES[f"knn_exact_{_m}"], QUERIES[f"knn_batch_{_m}"] = _exact(_m), _batch(_m)


@query
def knn_prefilter(spark, sf_dir):
    found = knn.prefilter(vectors(spark, sf_dir), F.col("label").isin(1, 2, 3), probe(spark, sf_dir), 10)
    return found.select("id", "label", F.round("score", 5).alias("score"), "rank")


@query
def knn_postfilter(spark, sf_dir):
    found = knn.postfilter(vectors(spark, sf_dir), F.col("label").isin(1, 2, 3), probe(spark, sf_dir), 10, overfetch=3)
    return found.select("id", "label", F.round("score", 5).alias("score"), "rank", "is_complete")


@query
def knn_variant_filter(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("metadata", F.try_parse_json(F.to_json(F.struct("label", F.concat(F.lit("g"), F.col("label") % 3).alias("grp")))))
    found = knn.prefilter(rows, parse_filter({"label": {"gte": 2, "lt": 8}, "grp": {"in": ["g0", "g1"]}}), probe(spark, sf_dir), 10, "dot")
    return found.select("id", "label", F.round("score", 5).alias("score"), "rank")


def _ranked(found):
    return found.select("qid", "id", F.round("score", 5).alias("score"), "rank")


# The filtered searches for every query of the set.


@query
def knn_prefilter_batch(spark, sf_dir):
    return _ranked(knn.batch(vectors(spark, sf_dir).where(F.col("label").isin(1, 2, 3)), probes(spark, sf_dir), 10))


@query
def knn_postfilter_batch(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = knn.assemble(knn.batch(rows, probes(spark, sf_dir), 30), rows, columns=("label",)).where(F.col("label").isin(1, 2, 3))
    each = Window.partitionBy("qid")
    kept = found.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "id"))).withColumn("is_complete", F.count("*").over(each) >= 10)
    return kept.where("rank <= 10").select("qid", "id", F.round("score", 5).alias("score"), "rank", "is_complete")


@query
def knn_variant_filter_batch(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("metadata", F.try_parse_json(F.to_json(F.struct("label", F.concat(F.lit("g"), F.col("label") % 3).alias("grp")))))
    return _ranked(knn.batch(rows.where(parse_filter({"label": {"gte": 2, "lt": 8}, "grp": {"in": ["g0", "g1"]}})), probes(spark, sf_dir), 10, "dot"))


@query
def result_assembly(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    hits = knn.batch(rows, probes(spark, sf_dir), 3, "euclidean")
    return knn.assemble(hits, rows).select("qid", "id", F.round("score", 5).alias("score"), "rank", "metadata")


# Filters over JSON: plain numbers in events.props, and mixed types made from the event's id.


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("metadata", F.try_parse_json("props"))


MIXED = "CASE event_id % 6 WHEN 0 THEN concat('{\"y\":', event_id % 50, '}') WHEN 1 THEN concat('{\"y\":\"', event_id % 50, '\"}') WHEN 2 THEN concat('{\"y\":', event_id % 50, '.5}') WHEN 3 THEN '{\"y\":true}' WHEN 4 THEN '{\"y\":null}' ELSE '{}' END"


def _filter(spec, mixed=False):
    def run(spark, sf_dir):
        rows = _events(spark, sf_dir)
        if mixed:
            rows = rows.withColumn("metadata", F.try_parse_json(F.expr(MIXED)))
        return rows.where(parse_filter(spec)).select("event_id")

    return run


FILTERS = {
    "filter_eq": {"k": 7}, "filter_gt": {"k": {"gt": 50}}, "filter_gte": {"k": {"gte": 50}}, "filter_lt": {"k": {"lt": 20}}, "filter_lte": {"k": {"lte": 20}},
    "filter_in": {"k": {"in": [1, 5, 9]}}, "filter_range": {"k": {"gte": 10, "lte": 30}}, "filter_empty": {}, "filter_missing_field": {"nothing": {"gt": 0}},
}
FILTERS_MIXED = {
    "filter_mixed_eq_number": {"y": 20}, "filter_mixed_eq_string": {"y": "19"}, "filter_mixed_gt_number": {"y": {"gt": 30}}, "filter_mixed_lt_string": {"y": {"lt": "3"}}, "filter_mixed_true": {"y": True}, "filter_mixed_in": {"y": {"in": [6, "7", 1]}},
}
QUERIES |= {k: _filter(v) for k, v in FILTERS.items()} | {k: _filter(v, True) for k, v in FILTERS_MIXED.items()}


#: Whole numbers that a double can't tell apart.
LARGE = 9_007_199_254_740_992


@query
def filter_large_numbers(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("metadata", F.try_parse_json(F.concat(F.lit('{"y":'), LARGE + F.col("event_id") % 10, F.lit("}"))))
    return rows.where(parse_filter({"y": {"gt": LARGE + 2, "lte": LARGE + 5}})).select("event_id")


@query
def filter_and(spark, sf_dir):
    return _events(spark, sf_dir).where(parse_filter({"k": {"gt": 10}}) & (F.col("event_type") == "click")).select("event_id")


# The log of a collection: all vectors are put, some deleted, updated, or put again.


def log(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"), "embedding", "label")
    part = lambda where, op, base, scale: rows.where(where).select((F.lit(base) + F.col("n")).alias("seq"), F.lit(op).alias("op"), "id", (F.lit(base) + F.col("n")).alias("slot_id"), F.transform("embedding", lambda x: x * scale).alias("embedding"), "label")
    return part("true", "put", 0, 1.0).unionByName(part("n % 5 = 3", "put", 1_000_000, -2.0)).unionByName(part("n % 10 = 3 or n % 10 = 4", "del", 2_000_000, 0.0)).unionByName(part("n % 20 = 4", "put", 3_000_000, 0.5))


@query
def live_view(spark, sf_dir):
    return oplog.live(log(spark, sf_dir)).select("id", "slot_id", "label")


@query
def count_live(spark, sf_dir):
    return oplog.live(log(spark, sf_dir)).agg(F.count("*").alias("n"))


@query
def count_all(spark, sf_dir):
    return log(spark, sf_dir).where("op = 'put'").agg(F.countDistinct("slot_id").alias("n"))


@query
def live_ids(spark, sf_dir):
    return oplog.live(log(spark, sf_dir)).select("id").orderBy("id")


@query
def get_by_id(spark, sf_dir):
    return oplog.live(log(spark, sf_dir).where("id = '8'")).select("id", "slot_id", F.round(F.get("embedding", F.lit(0)), 5).alias("first"))


@query
def max_slot(spark, sf_dir):
    return oplog.next_slot(log(spark, sf_dir))


@query
def tombstoned_slots(spark, sf_dir):
    return oplog.tombstones(log(spark, sf_dir))


@query
def search_excludes_tombstones(spark, sf_dir):
    rows = oplog.live(log(spark, sf_dir))
    return knn.search(rows, probe(spark, sf_dir), 20, "euclidean").select("id", F.round("score", 5).alias("score"), "rank")


@query
def search_excludes_tombstones_batch(spark, sf_dir):
    return _ranked(knn.batch(oplog.live(log(spark, sf_dir)), probes(spark, sf_dir), 20, "euclidean"))


@query
def update_latest_wins(spark, sf_dir):
    return oplog.live(log(spark, sf_dir)).where("slot_id >= 1000000 and slot_id < 2000000").select("id", "slot_id", F.round(F.get("embedding", F.lit(0)), 5).alias("first"))


@query
def reinsert_after_delete(spark, sf_dir):
    return oplog.live(log(spark, sf_dir)).where("slot_id >= 3000000").select("id", "slot_id", F.round(F.get("embedding", F.lit(0)), 5).alias("first"))


def _records(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = F.col("vec_id")
    id_ = F.when(n % 11 == 1, "bad id").when(n % 13 == 2, "").when(n % 17 == 3, F.lit(None)).when(n % 19 == 4, (n - 1).cast("string")).otherwise(n.cast("string"))
    vector = F.when(n % 23 == 5, F.slice("embedding", 1, 3)).when(n % 29 == 6, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).when(n % 31 == 7, F.lit(None)).otherwise(F.col("embedding"))
    metadata = F.when(n % 37 == 8, "[1]").when(n % 41 == 9, "{oops").otherwise('{"a":1}')
    return rows.select(n.alias("pos"), id_.alias("id"), vector.alias("vector"), metadata.alias("metadata"))


@query
def batch_insert_errors(spark, sf_dir):
    live = spark.range(0, 50).select((F.col("id") * 7).cast("string").alias("id"))
    return oplog.classify(_records(spark, sf_dir), live, 64).select("pos", "error")


@query
def batch_insert_report(spark, sf_dir):
    live = spark.range(0, 50).select((F.col("id") * 7).cast("string").alias("id"))
    return oplog.report(oplog.classify(_records(spark, sf_dir), live, 64))


@query
def id_validation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    id_ = F.expr("CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '/') WHEN 2 THEN repeat('x', CAST(c_custkey % 1000 AS INT)) ELSE replace(c_name, '#', ' ') END")
    return rows.select("c_custkey", id_error(id_).alias("error"))


# Measures.


@query
def recall_at_k(spark, sf_dir):
    rows, q = vectors(spark, sf_dir), probes(spark, sf_dir)
    truth = knn.batch(rows, q, 10, "euclidean")
    found = knn.batch(rows.where("id % 4 <> 1"), q, 10, "euclidean")
    return evaluate.recall(found, truth, 10).select("qid", F.round("recall", 6).alias("recall"))


@query
def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value").select(*(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "min", "max")))


@query
def monotonicity_violations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate.monotonicity_violations(rows, "event_type", "event_id", "value", 0.01).select("event_id", "event_type", F.round("value", 6).alias("value"), F.round("before", 6).alias("before"))


@query
def monotonicity_violations_falling(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate.monotonicity_violations(rows, "event_type", "event_id", "value", 0.01, rising=False).select("event_id", "event_type", F.round("value", 6).alias("value"), F.round("before", 6).alias("before"))


@query
def query_rates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 97).alias("run"), (F.abs("value") + 1).alias("seconds"))
    return evaluate.rates(rows, "run", "seconds").select(*(F.round(c, 6).alias(c) for c in ("median", "min", "max")))


@query
def estimate_memory(spark, sf_dir):
    sizes = [1, 1000, 50_000, 1_000_000]
    rows = [(n, *evaluate.estimate_memory(n, 128, 16).values()) for n in sizes]
    return spark.createDataFrame(rows, "n long, graph_bytes long, vector_bytes long, metadata_bytes long, total_bytes long, total_mb double").withColumn("total_mb", F.round("total_mb", 6))


def _layers(spark, sf_dir):
    uniform = (F.col("id") * 7919 % 10007 + 1) / F.lit(10008.0)
    return vectors(spark, sf_dir).select("id", ann.layer_of(uniform, 4).alias("layer"))


@query
def layer_assignment(spark, sf_dir):
    return _layers(spark, sf_dir)


@query
def layer_histogram(spark, sf_dir):
    return evaluate.layer_histogram(_layers(spark, sf_dir))


@query
def entry_point_recovery(spark, sf_dir):
    nodes = _layers(spark, sf_dir).withColumnRenamed("id", "node")
    return ann.entry_point(nodes, nodes.where("node % 3 = 0"))


# Graphs and approximate search.


def _candidates(spark, sf_dir, nodes=probes):
    found = knn.batch(vectors(spark, sf_dir), nodes(spark, sf_dir), 30, "euclidean").where("id <> qid")
    return found.select(F.col("qid").alias("node"), F.col("id").alias("other"), F.col("score").alias("distance"))


def every_row(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))


def _groups(spark, sf_dir):
    return ann.grouped(vectors(spark, sf_dir).withColumn("cell", F.lit(0)))


def graph_audit(spark, sf_dir, max_degree=64):
    """Problems of the graph that ``build_graph`` makes, over all nodes; it has no SQL."""
    edges = ann.build_graph(_groups(spark, sf_dir)).select("node", "other")
    return evaluate.graph_problems(edges, vectors(spark, sf_dir).select(F.col("id").alias("node")), max_degree)


@query
def select_neighbors_simple(spark, sf_dir):
    return ann.select_simple(_candidates(spark, sf_dir), 8).select("node", "other", F.round("distance", 5).alias("distance"), "rank")


@query
def select_neighbors_simple_all(spark, sf_dir):
    return ann.select_simple(_candidates(spark, sf_dir, every_row), 8).select("node", "other", F.round("distance", 5).alias("distance"), "rank")


@query
def select_neighbors_heuristic(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("id").alias("other"), F.col("embedding").alias("vector"))
    return ann.select_diverse(ann.candidates(_groups(spark, sf_dir), 29).join(rows, "other"), 8).select("node", "other", F.round("distance", 5).alias("distance"))


@query
def graph_integrity(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    edges = ann.select_simple(_candidates(spark, sf_dir), 8).select("node", "other")
    both = edges.where("other % 2 = 0").select(F.col("other").alias("node"), F.col("node").alias("other")).unionByName(edges).distinct()
    return evaluate.graph_problems(both, rows.where("id % 9 <> 5").select(F.col("id").alias("node")), 7)


@query
def ivf_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centres = ann.fit_centres(rows)
    found = ann.search_ivf(ann.build_ivf(rows, centres), centres, probes(spark, sf_dir), 10, max(1, int(0.6 * len(centres))))
    return found.select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query
def hnsw_search(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    found = ann.search_graph(groups, ann.build_graph(groups), probes(spark, sf_dir), 10, ef=64, metric="euclidean")
    return found.select("qid", "id", F.round("score", 5).alias("score"), "rank")


