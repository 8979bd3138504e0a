"""Sets of vectors to measure searches with, and a place for the measurements."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.validate import check_metric
from corvane.operators import knn

#: Vectors that one random stream makes; row n is the same whatever the number of rows or partitions.
BLOCK = 1024


@dataclass(frozen=True)
class Bundle:
    """``train`` (id, embedding), ``test`` (qid, q) and the true ``neighbors`` (qid, id, score, rank)."""

    train: DataFrame
    test: DataFrame
    neighbors: DataFrame

    def save(self, path: str) -> None:
        for part in ("train", "test", "neighbors"):
            getattr(self, part).write.parquet(f"{path}/{part}")


def load_bundle(spark: SparkSession, path: str, max_train: int | None = None, max_queries: int | None = None, k: int = 10, metric: str = "cosine") -> Bundle:
    """What ``Bundle.save`` wrote; with fewer rows (the least ids) the neighbours are searched anew."""
    train, test, neighbors = (spark.read.parquet(f"{path}/{part}") for part in ("train", "test", "neighbors"))
    if max_queries is not None:
        test = test.orderBy("qid").limit(max_queries)
        neighbors = neighbors.join(test.select("qid"), "qid", "left_semi")
    if max_train is not None:
        train = train.orderBy("id").limit(max_train)
        neighbors = knn.batch(train, test, k, metric)
    return Bundle(train, test, neighbors)


def normal_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """(id, embedding): n standard normal vectors of floats, made on the executors."""

    def make(batches):
        for pdf in batches:
            for block in pdf["id"]:
                ids = np.arange(block * BLOCK, min((block + 1) * BLOCK, n))
                x = np.random.default_rng([seed, int(block)]).standard_normal((BLOCK, dimension), np.float32)[: len(ids)]
                yield pd.DataFrame({"id": ids, "embedding": list(x)})

    return spark.range(-(-n // BLOCK)).mapInPandas(make, "id long, embedding array<float>")


def synthetic(spark: SparkSession, n_train: int, n_queries: int, dimension: int, k: int = 10, metric: str = "cosine", seed: int = 42) -> Bundle:
    """Random vectors and queries with their exact neighbours."""
    check_metric(metric)
    train = normal_vectors(spark, n_train, dimension, seed)
    test = normal_vectors(spark, n_queries, dimension, seed + 1).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    return Bundle(train, test, knn.batch(train, test, k, metric))


def append_csv(results: DataFrame, path: str) -> None:
    """Adds measurements to a folder of CSV files, each with a header."""
    results.write.mode("append").option("header", True).csv(path)
