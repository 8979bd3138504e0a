"""Exact nearest neighbours: one query, batches of queries, and filtered searches."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.errors import InvalidSearch
from corvane.functions.metrics import HIGHER, best_first, score
from corvane.functions.validate import check_metric, check_search

#: Queries that are sent to the executors at most; more meet the rows block by block.
QUERY_BLOCK = 4096
#: Queries and rows of a pair of blocks, on average.
PAIR_QUERIES, PAIR_ROWS = 65_536, 32_768
#: Queries and rows that are multiplied at once, and pairs of them that are scored at once.
TILE, PAIRS = 1024, 16_384


def search(rows: DataFrame, query, k: int, metric: str = "cosine", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The k best rows for one query (a list, or a one-row DataFrame with a column ``q``), ranked from 1.

    Ties go to the lesser id.  Fewer rows than k give them all, an empty table none.
    """
    check_search(k)
    if isinstance(query, DataFrame):
        scored = rows.crossJoin(F.broadcast(query.limit(1).select("q")))
    else:
        scored = rows.withColumn("q", F.array(*(F.lit(float(x)) for x in query)))
    top = scored.withColumn("score", score(metric, vector, "q")).drop("q").orderBy(best_first(metric), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(best_first(metric), id_col)))


def prefilter(rows: DataFrame, condition: Column, query, k: int, metric: str = "cosine", **names) -> DataFrame:
    """The k best of the rows that meet the condition: exact, and full whenever k rows do."""
    return search(rows.where(condition), query, k, metric, **names)


def postfilter(rows: DataFrame, condition: Column, query, k: int, metric: str = "cosine", overfetch: int = 3, warn: bool = False, **names) -> DataFrame:
    """The best k * overfetch rows, of which those that meet the condition are kept, k at most.

    ``is_complete`` says whether there are k.  With ``warn`` the rows are counted and a warning given.
    """
    check_search(k, overfetch=overfetch)
    id_col = names.get("id_col", "id")
    found = search(rows, query, k * overfetch, metric, **names).where(condition)
    order = Window.orderBy(best_first(metric), id_col)
    out = found.withColumn("rank", F.row_number().over(order)).withColumn("is_complete", F.count("*").over(Window.partitionBy(F.lit(1))) >= k).where(F.col("rank") <= k)
    if warn and (n := out.count()) < k:
        warnings.warn(f"only {n} of {k} results meet the filter; raise the overfetch factor or filter first", UserWarning, stacklevel=2)
    return out


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow column as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.zeros((0, 0))
    sizes = pc.unique(pc.list_value_length(whole))
    if whole.null_count or len(sizes) > 1 or whole.flatten().null_count:
        raise ValueError("vectors that are null, hold nulls or differ in length can't be compared")
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(whole), -1)


def scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The score of each row of q with the same row of x; equal rows get the very same score."""
    if metric == "euclidean":
        return np.sqrt(((q - x) ** 2).sum(1))
    products = (q * x).sum(1)
    return products if metric == "dot" else np.clip(products / np.sqrt((q * q).sum(1) * (x * x).sum(1)), -1, 1)


def _rough(metric: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors whose product ranks as the costs do, what to add to it, and how far rounding may take it from them."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    if metric == "cosine":
        if not (qq.all() and xx.all()):
            raise ValueError("cosine of a zero vector")
        return -q / np.sqrt(qq)[:, None], x / np.sqrt(xx)[:, None], np.zeros(len(q)), np.full(len(q), 1e-11)
    if metric == "dot":
        return -q, x, np.zeros(len(q)), 1e-11 * np.sqrt(qq * xx.max())
    return np.c_[-2 * q, np.ones(len(q))], np.c_[x, xx], qq, 1e-11 * (qq + xx.max())


def k_best(q: np.ndarray, parts: Iterable[tuple[np.ndarray, np.ndarray]], k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the k best for every query among all parts (ids, vectors); of equal scores the lesser ids.

    A product of a tile of queries and one of rows finds what may be among the best so far, which is then
    scored by itself.  Beside the blocks given, a tile and k rows per query are held.
    """
    sign = -1.0 if HIGHER[metric] else 1.0
    cost, names = np.full((len(q), k), np.inf), None
    for ids, x in parts:
        if not len(ids) or not len(q):
            continue
        names = np.full((len(q), k), ids[0], ids.dtype) if names is None else names
        left, right, plus, slack = _rough(metric, q, x)
        for lo in range(0, len(x), TILE):
            for at in range(0, len(q), TILE):
                end = slice(at, at + TILE)
                rough = left[end] @ right[lo : lo + TILE].T
                limit = cost[end, -1] ** 2 if metric == "euclidean" else cost[end, -1]
                limit = limit - plus[end] + slack[end]
                hit = rough <= limit[:, None]
                if rough.shape[1] > k and np.count_nonzero(hit) > 2 * k * len(rough):
                    edge = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack[end]
                    hit = rough <= np.minimum(limit, edge)[:, None]
                qi, xi = np.nonzero(hit)
                qi, xi = qi + at, xi + lo
                own = np.concatenate([np.zeros(0), *(sign * scores(metric, q[qi[i : i + PAIRS]], x[xi[i : i + PAIRS]]) for i in range(0, len(qi), PAIRS))])
                near = own <= cost[qi, -1]
                qi, xi, own = qi[near], xi[near], own[near]
                if not len(qi):
                    continue
                some = np.unique(qi)
                who = np.concatenate([np.repeat(some, k), qi])
                costs, ids_ = np.concatenate([cost[some].ravel(), own]), np.concatenate([names[some].ravel(), ids[xi]])
                order = np.lexsort((ids_, costs, who))
                first = np.searchsorted(who[order], some)[:, None] + np.arange(k)
                cost[some], names[some] = costs[order[first]], ids_[order[first]]
    if names is None:
        return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)  # no row tells the kind of the ids; this becomes any
    qi, at = np.nonzero(np.isfinite(cost))
    return qi, names[qi, at], sign * cost[qi, at]


def _ids(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def in_cells(rows: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """(qid, id, score): for every query (cell, qid, q) the k best rows (cell, id, vector) of each part of its cell.

    A cell's rows and its queries are split by hash into blocks of bounded size, and every block of
    queries meets every block of rows in a task of its own.  Ranks over all parts are left to the caller.
    """
    blocks = lambda f, size, name: f.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    sizes = F.broadcast(blocks(rows, PAIR_ROWS, "parts").join(blocks(queries, PAIR_QUERIES, "sets"), "cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = queries.join(sizes, "cell").select("cell", every("parts").alias("part"), one("qid", "sets").alias("set"), "qid", "q")
    right = rows.join(sizes, "cell").select("cell", one("id", "parts").alias("part"), every("sets").alias("set"), "id", "vector")
    kinds = dict(left.dtypes) | dict(right.dtypes)

    def best(some: pa.Table, other: pa.Table) -> pa.Table:
        qi, ids, score = k_best(_matrix(some["q"]), [(_ids(other["id"]), _matrix(other["vector"]))], k, metric)
        return pa.table({"qid": some["qid"].take(qi), "id": pa.array(ids, other.schema.field("id").type), "score": score})

    key = ("cell", "part", "set")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, f"qid {kinds['qid']}, id {kinds['id']}, score double")


def batch(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, score, rank): the k best rows for every query (qid, q).

    Up to ``block`` queries go out to all partitions of the rows, which keep their own k best per query;
    more are split into blocks that meet blocks of the rows (see ``in_cells``).
    """
    check_search(k)
    check_metric(metric)
    named = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    few = queries.select("qid", "q").limit(block + 1).toArrow()  # a block of bounded size
    if few.num_rows > block:
        cell = F.lit(0).alias("cell")
        out = in_cells(named.select(cell, "id", "vector"), queries.select(cell, "qid", "q"), k, metric)
    else:
        kinds = dict(named.dtypes) | dict(queries.dtypes)
        id_type = to_arrow_type(named.schema["id"].dataType)
        shared = rows.sparkSession.sparkContext.broadcast((few["qid"].combine_chunks(), _matrix(few["q"])))

        def best(batches):
            qid, q = shared.value
            qi, ids, score = k_best(q, ((_ids(b["id"]), _matrix(b["vector"])) for b in batches), k, metric)
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(qi)), pa.array(ids, id_type), pa.array(score)], ["qid", "id", "score"])

        out = named.mapInArrow(best, f"qid {kinds['qid']}, id {kinds['id']}, score double")
    order = Window.partitionBy("qid").orderBy(best_first(metric), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def assemble(hits: DataFrame, rows: DataFrame, id_col: str = "id", columns: tuple[str, ...] = ("metadata",)) -> DataFrame:
    """Hits with the columns of their rows; hits come first in the join, as there are few."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise InvalidSearch(f"no column {missing[0]!r}")
    return hits.join(rows.select(id_col, *columns), id_col)
