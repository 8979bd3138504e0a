"""Measures: recall, percentiles, monotonicity, memory."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the true k (qid, id, rank) that was found; k = 0 counts as 1."""
    want = truth.where(F.col("rank") <= k).select("qid", "id")
    got = found.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit")).distinct()
    share = F.lit(1.0) if k == 0 else F.sum(F.coalesce("hit", F.lit(0))) / F.lit(float(k))
    queries = truth.select("qid").distinct() if k == 0 else want
    return queries.join(got, ["qid", "id"] if k else ["qid"], "left").groupBy("qid").agg(share.alias("recall"))


def percentiles(rows: DataFrame, column: str) -> DataFrame:
    """Exact percentiles with linear interpolation, least and greatest."""
    at = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.agg(at.alias("p"), F.min(column).alias("min"), F.max(column).alias("max")).select(F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"), "min", "max")


def monotonicity_violations(rows: DataFrame, group: str, order: str, value: str, tolerance: float = 0.0, rising: bool = True) -> DataFrame:
    """Neighbours in order whose value falls by more than the tolerance, or rises if it should be falling."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    wrong = F.col(value) < F.col("before") - tolerance if rising else F.col(value) > F.col("before") + tolerance
    return rows.withColumn("before", before).where(wrong)


def rates(runs: DataFrame, run: str, seconds: str) -> DataFrame:
    """Median, least and greatest number of rows a second over the runs; ``seconds`` is what a row took."""
    each = runs.groupBy(run).agg((F.count("*") / F.sum(seconds)).alias("rate"))
    return each.agg(F.percentile("rate", F.lit(0.5)).alias("median"), F.min("rate").alias("min"), F.max("rate").alias("max"))


def estimate_memory(n: int, dimension: int, m: int = 16) -> dict:
    """Bytes of an index over n vectors: graph, vectors, metadata."""
    layers = 1.0 if n <= 1 else 1 + math.log(n) / math.log(m)
    graph, vectors, metadata = int(n * 2 * m * 8 * layers), n * dimension * 4, n * 200
    total = graph + vectors + metadata
    return {"graph_bytes": graph, "vector_bytes": vectors, "metadata_bytes": metadata, "total_bytes": total, "total_mb": total / (1024 * 1024)}


def layer_of(u, m: int):
    """The layer of a node from a uniform number in [0, 1)."""
    return F.floor(-F.log(F.greatest(u, F.lit(1e-10))) / F.lit(math.log(m))).cast("int")


def layer_histogram(nodes: DataFrame, layer: str = "layer") -> DataFrame:
    return nodes.groupBy(layer).agg(F.count("*").alias("n"))


def graph_problems(edges: DataFrame, nodes: DataFrame, max_degree: int) -> DataFrame:
    """(problem, node, other): too many neighbours, neighbours that don't exist, edges without a way back.

    ``edges`` has (node, other) pairs, ``nodes`` a column ``node``.
    """
    degree = edges.groupBy("node").count().where(F.col("count") > max_degree).select(F.lit("degree").alias("problem"), "node", F.lit(None).cast("long").alias("other"))
    missing = edges.join(nodes.select(F.col("node").alias("other")), "other", "left_anti").select(F.lit("missing").alias("problem"), "node", "other")
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"))
    one_way = edges.join(back, ["node", "other"], "left_anti").select(F.lit("one_way").alias("problem"), "node", "other")
    return degree.unionByName(missing).unionByName(one_way)
