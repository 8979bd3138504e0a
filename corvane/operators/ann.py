"""Approximate nearest neighbours: an inverted-file index and a layered neighbour graph.

Both are tables.  The inverted file puts every row in the cell of its nearest centre; a search reads
the cells nearest to its queries.  The graph has edges between near rows of a cell, chosen for
diversity; large cells are split into groups, and a search enters every group at the best nodes of a
sparse upper layer and widens a beam there; a task walks one group with a block of the queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.metrics import HIGHER, best_first
from corvane.functions.validate import check_metric, check_search
from corvane.operators import knn
from corvane.operators.evaluate import layer_of

#: Rows that centres are fitted on, at most; every row is indexed.
TRAINED = 20_000
#: Rows of a cell that are linked among themselves in one group, on average; larger cells are split.
SHARD = 4_000
#: Queries that walk a group at once in a task.
WALKED = 128


def fit_centres(rows: DataFrame, cells: int = 0, vector: str = "embedding", id_col: str = "id", steps: int = 12, seed: int = 42) -> np.ndarray:
    """Centres by k-means over unit vectors, from at most TRAINED rows with the least hash."""
    named = rows.select(F.xxhash64(id_col).alias("hash"), F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    # The bound is found without the vectors, so that no task gathers them from all partitions.
    bound = named.select("hash", "id").orderBy("hash", "id").limit(TRAINED).agg(F.max(F.struct("hash", "id")).alias("most"))
    sample = named.join(F.broadcast(bound), F.struct("hash", "id") <= F.col("most")).select("hash", "id", "vector").toPandas().sort_values(["hash", "id"])
    x = np.array(sample["vector"].tolist(), np.float64).reshape(len(sample), -1)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    cells = min(cells or max(1, int(math.sqrt(len(x)))), len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(steps):
        near = (x @ centres.T).argmax(1)
        for c in range(cells):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _cells(frame: DataFrame, centres: np.ndarray, vector: str, n: int) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64)
        order = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :n]
        return pd.Series(list(order.astype(np.int32)))

    return frame.withColumn("cell", F.explode(nearest(vector)))


def build_ivf(rows: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The rows with their ``cell``."""
    return _cells(rows, centres, vector, 1)


def search_ivf(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, nprobe: int = 8, metric: str = "cosine", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(qid, id, score, rank) from the ``nprobe`` cells nearest to each query (qid, q)."""
    check_search(k)
    check_metric(metric)
    probes = _cells(queries.select("qid", "q"), centres, "q", nprobe)
    scored = knn.in_cells(index.select("cell", F.col(id_col).alias("id"), F.col(vector).alias("vector")), probes, k, metric)
    order = Window.partitionBy("qid").orderBy(best_first(metric), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_simple(candidates: DataFrame, m: int) -> DataFrame:
    """The m nearest candidates (node, other, distance) of every node."""
    order = Window.partitionBy("node").orderBy("distance", "other")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)


def diverse(x: np.ndarray, distance: np.ndarray, m: int) -> list[int]:
    """Candidates, nearest first, each nearer to the node than to any candidate accepted before it."""
    taken: list[int] = []
    for c in np.argsort(distance, kind="stable").tolist():
        if len(taken) == m:
            break
        if all(np.linalg.norm(x[c] - x[t]) >= distance[c] for t in taken):
            taken.append(c)
    return taken


def select_diverse(candidates: DataFrame, m: int) -> DataFrame:
    """Neighbours (node, other, distance) by the diversity rule; candidates have a ``vector`` of ``other``."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "other"]).reset_index(drop=True)
        return pdf.loc[diverse(np.array(pdf["vector"].tolist(), np.float64), pdf["distance"].to_numpy(), m), ["node", "other", "distance"]]

    return candidates.select("node", "other", "distance", "vector").groupBy("node").applyInPandas(choose, "node long, other long, distance double")


def grouped(index: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows with the ``shard`` of their ``cell`` that they are linked in.

    A cell is split by hash into groups of about SHARD rows, so a group's size doesn't grow with the data.
    """
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(SHARD)).alias("shards"))
    return index.join(F.broadcast(sizes), "cell").withColumn("shard", F.pmod(F.xxhash64(id_col), F.col("shards"))).drop("shards")


def candidates(groups: DataFrame, n: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(node, other, distance): the n nearest other rows (euclidean) of every row in its group (see ``grouped``)."""

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf[id_col].to_numpy(), np.array(pdf[vector].tolist(), np.float64)
        k, out = min(n, len(x) - 1), []
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512]
            d = np.sqrt(np.maximum((part * part).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * part @ x.T, 0))
            d[np.arange(len(part)), lo + np.arange(len(part))] = np.inf
            best = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
            out.append(pd.DataFrame({"node": np.repeat(ids[lo : lo + 512], k), "other": ids[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(out)

    return groups.select("cell", "shard", id_col, vector).groupBy("cell", "shard").applyInPandas(near, "node long, other long, distance double")


def build_graph(groups: DataFrame, m: int = 16, ef_construction: int = 64, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(cell, shard, node, other): links both ways, from diverse neighbours among the rows of a group (euclidean).

    ``groups`` are rows with a ``cell`` and ``shard`` (see ``grouped``).
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf[id_col].to_numpy(), np.array(pdf[vector].tolist(), np.float64)
        out = []
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512]
            d = np.sqrt(np.maximum((part * part).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * part @ x.T, 0))
            d[np.arange(len(part)), lo + np.arange(len(part))] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, : min(ef_construction, len(x) - 1)]
            out += [(ids[lo + i], ids[near[i][c]]) for i in range(len(part)) for c in diverse(x[near[i]], d[i, near[i]], m)]
        return pd.DataFrame(out, columns=["node", "other"], dtype="int64")

    def linked(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return link(pdf).assign(cell=key[0], shard=key[1])[["cell", "shard", "node", "other"]]

    kinds = dict(groups.dtypes)
    one = groups.select("cell", "shard", id_col, vector).groupBy("cell", "shard").applyInPandas(linked, f"cell {kinds['cell']}, shard {kinds['shard']}, node long, other long")
    return one.unionByName(one.select("cell", "shard", F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def _walk(group: pd.DataFrame, q: np.ndarray, k: int, ef: int, rounds: int, entries: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the k best living rows that a beam of every query meets in one group."""
    group = group.sort_values("id").reset_index(drop=True)
    ids, x, dead = group["id"].to_numpy(), np.array(group["v"].tolist(), np.float64), group["dead"].to_numpy(bool)
    others = [np.searchsorted(ids, o) if o is not None else np.zeros(0, np.int64) for o in group["others"]]
    degree = np.array([len(o) for o in others])
    start, links = np.cumsum(degree) - degree, np.concatenate(others).astype(np.int64)
    upper = np.flatnonzero(group["layer"] >= 1)
    upper = upper if len(upper) else np.arange(len(x))
    sign = -1.0 if HIGHER[metric] else 1.0
    found = []
    for lo in range(0, len(q), WALKED):
        part = q[lo : lo + WALKED]
        cost, seen, open_ = np.full((len(part), len(x)), np.inf), np.zeros((len(part), len(x)), bool), np.zeros((len(part), len(x)), bool)

        def meet(qi, xi, part=part, cost=cost):
            for i in range(0, len(qi), knn.PAIRS):
                a, b = qi[i : i + knn.PAIRS], xi[i : i + knn.PAIRS]
                cost[a, b] = sign * knn.scores(metric, part[a], x[b])

        def best(c, n):
            """The n least of every query, of equal ones the lesser ids: columns are in their order."""
            n = min(n, c.shape[1])
            qi, xi = np.nonzero(c <= np.partition(c, n - 1, axis=1)[:, n - 1 : n])
            order = np.lexsort((xi, c[qi, xi], qi))
            qi, xi = qi[order], xi[order]
            few = (np.arange(len(qi)) - np.searchsorted(qi, qi) < n) & np.isfinite(c[qi, xi])
            return qi[few], xi[few]

        meet(np.repeat(np.arange(len(part)), len(upper)), np.tile(upper, len(part)))
        qi, xi = best(cost, entries)
        mark = np.zeros_like(seen)
        mark[qi, xi] = True
        cost[~mark] = np.inf
        seen |= mark
        for _ in range(rounds):
            new = ~open_[qi, xi]  # the neighbours of the rest are seen
            qi, xi = qi[new], xi[new]
            open_[qi, xi] = True
            step = np.zeros_like(seen)
            n = degree[xi]
            step[np.repeat(qi, n), links[np.repeat(start[xi] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
            step &= ~seen
            seen |= step
            meet(*np.nonzero(step))
            qi, xi = best(cost, ef)
        cost[:, dead] = np.inf
        qi, xi = best(cost, k)
        found.append((qi + lo, ids[xi], sign * cost[qi, xi]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search_graph(groups: DataFrame, edges: DataFrame, queries: DataFrame, k: int, ef: int = 64, m: int = 16, rounds: int = 4, metric: str = "cosine", entries: int = 8, id_col: str = "id", vector: str = "embedding", skip=None) -> DataFrame:
    """(qid, id, score, rank) by a beam in every group of the graph; ``skip`` rows are walked through but not returned.

    No edge leaves a group (cell, shard), so each has its own entries and its own ``ef``, and the best
    of all groups are merged: a task walks one group with a block of the queries.  Layers follow from a
    hash of the id.  Each query enters a group at the ``entries`` best of its nodes in layer 1 and above,
    or of all its nodes if it has none there; every round scores the unseen neighbours of its ``ef`` best so far.
    """
    check_search(k, ef)
    check_metric(metric)
    uniform = (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    points = groups.select("cell", "shard", F.col(id_col).alias("id"), F.col(vector).alias("v"), layer_of(uniform, m).alias("layer"))
    gone = skip.select("id", F.lit(True).alias("gone")).distinct() if skip is not None else None
    points = points.withColumn("dead", F.lit(False)) if gone is None else points.join(gone, "id", "left").withColumn("dead", F.col("gone").isNotNull()).drop("gone")
    links = edges.groupBy("cell", "shard", F.col("node").alias("id")).agg(F.collect_list("other").alias("others"))
    key = ["cell", "shard", "set"]
    # Every block of the queries goes to every group.
    sets = F.broadcast(queries.agg(F.ceil(F.count("*") / F.lit(knn.PAIR_QUERIES)).cast("int").alias("sets")))
    wanted = queries.select("qid", "q").crossJoin(sets).withColumn("set", F.pmod(F.xxhash64("qid"), "sets").cast("int"))
    asked = F.broadcast(groups.select("cell", "shard").distinct()).crossJoin(wanted).select(*(F.col(c).alias(c) for c in (*key, "qid", "q")))
    nodes = points.join(links, ["cell", "shard", "id"], "left").crossJoin(sets).withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).drop("sets")
    kinds = dict(queries.dtypes) | {"id": dict(points.dtypes)["id"]}

    def walk(group: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(some):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        qi, ids, score = _walk(group, np.array(some["q"].tolist(), np.float64), k, ef, rounds, entries, metric)
        return pd.DataFrame({"qid": some["qid"].to_numpy()[qi], "id": ids, "score": score})

    met = nodes.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(walk, f"qid {kinds['qid']}, id {kinds['id']}, score double")
    order = Window.partitionBy("qid").orderBy(best_first(metric), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def entry_point(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """The live node (node, layer) of the highest layer; none if all are dead."""
    return nodes.join(dead.select("node"), "node", "left_anti").orderBy(F.desc("layer"), "node").limit(1)


