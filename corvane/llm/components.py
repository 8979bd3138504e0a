"""Connected components of a graph in two columns, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b) reaches.

    Each step hangs a node's neighbours onto the least one; the number of steps grows with the
    logarithm of the longest path.  A node with very many neighbours is one sum per task before the
    shuffle, and its own edges meet it in a join that Spark may split.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour goes to the least of the node's neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours all go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        following = scratch.store(small, "edges")
        # It is done once no node has two parents and no parent has one itself.
        again = following.join(following.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() or following.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        edges = following
        if not again:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
