"""Metrics, filters, validation and approximate search on small, hand-made rows."""

import math
import warnings

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane import errors
from corvane.functions import filters, metrics, validate
from corvane.operators import ann, evaluate, knn, oplog


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_metrics(spark):
    a, b = vec(1, 2, 3), vec(4, 5, 6)
    assert value(spark, metrics.cosine(a, b)) == pytest.approx(0.9746318, abs=1e-6)
    assert value(spark, metrics.dot(a, b)) == 32
    assert value(spark, metrics.euclidean(a, b)) == pytest.approx(math.sqrt(27))
    assert value(spark, metrics.dot(a, vec(0, 0, 0))) == 0
    with pytest.raises(PySparkException):
        value(spark, metrics.cosine(a, vec(0, 0, 0)))
    with pytest.raises(errors.InvalidConfig):
        metrics.score("manhattan", a, b)


@pytest.mark.parametrize("metric,best", [("cosine", ["a", "d", "b"]), ("euclidean", ["a", "b", "c"]), ("dot", ["d", "a", "b"])])
def test_search_small(spark, metric, best):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [0.0, 1.0]), ("d", [9.0, 1.0])], "id string, embedding array<float>")
    got = knn.search(rows, [1.0, 0.0], 3, metric).orderBy("rank").collect()
    assert [r.id for r in got] == best and [r["rank"] for r in got] == [1, 2, 3]
    batch = knn.batch(rows, spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>"), 3, metric).orderBy("rank").collect()
    assert [r.id for r in batch] == best
    assert knn.search(rows.limit(0), [1.0, 0.0], 3, metric).count() == 0


def test_ties_go_to_the_lesser_id_in_many_blocks(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(7)], "qid long, q array<double>")
    got = knn.batch(rows, q, 3, "dot", block=2).collect()
    assert len(got) == 21 and {r.id for r in got} == {0, 1, 2}


def test_postfilter_warns(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i) for i in range(10)], "id long, embedding array<float>, n int")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        got = knn.postfilter(rows, F.col("n") < 2, [9.0, 1.0], 2, "euclidean", 2, warn=True).collect()
    assert got == [] and len([w for w in seen if "overfetch" in str(w.message)]) == 1
    assert knn.prefilter(rows, F.col("n") < 2, [9.0, 1.0], 2, "euclidean").count() == 2


@pytest.mark.parametrize("doc,spec,holds", [
    ('{"y":2024}', {"y": 2024}, True), ('{"y":2024}', {"y": "2024"}, False), ('{"y":"2024"}', {"y": 2024}, False), ('{"y":2024.0}', {"y": 2024}, True),
    ('{"y":"abc"}', {"y": {"gt": 5}}, True), ('{"y":5}', {"y": {"lt": "abc"}}, True), ('{"y":5}', {"y": {"gt": "abc"}}, False), ('{"y":true}', {"y": True}, True),
    ('{"y":true}', {"y": 1}, True), ('{"y":true}', {"y": "true"}, False), ('{"y":null}', {"y": 1}, None), ("{}", {"y": {"lt": 1}}, None),
    ('{"y":[1,2]}', {"y": "[1,2]"}, True), ('{"y":2}', {"y": {"in": [1, None]}}, None), ('{"a-b":1}', {"a-b": 1}, True), ('{"y":3}', {}, True),
])
def test_filters(spark, doc, spec, holds):
    row = spark.createDataFrame([(doc,)], "j string").select(F.parse_json("j").alias("metadata"))
    assert row.select(filters.parse_filter(spec).alias("x")).first().x is holds


@pytest.mark.parametrize("spec", [{"f": {"between": 1}}, {"f": {"in": []}}, {"fi/eld": 1}, {"f": {}}, {"f": [1]}, {"": 1}])
def test_bad_filters(spec, spark):
    with pytest.raises(errors.FilterError):
        filters.parse_filter(spec)


def test_vector_errors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("-inf")]), (7, [0.0, 0.0]), (8, [1e39, 1.0])], "n int, v array<double>")
    got = {r.n: r.e for r in rows.select("n", validate.vector_error(F.col("v"), 2, "cosine").alias("e")).collect()}
    assert got == {0: None, 1: "null_vector", 2: "empty_vector", 3: "wrong_dimension", 4: "null_element", 5: "nan_element", 6: "infinite_element", 7: "zero_vector", 8: "infinite_element"}


def test_id_errors(spark):
    ids = ["ok-1_x", None, "", "x" * 512, "x" * 513, "a/b", "a b", "a\tb", "a\nb", "a\0b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "n int, id string")
    got = [r.e for r in rows.select("n", validate.id_error(F.col("id")).alias("e")).orderBy("n").collect()]
    assert got == [None, "null_id", "empty_id", None, "long_id", *["bad_character"] * 5]


def test_driver_checks():
    validate.check_config("docs", 3, "cosine", 2, 10)
    for bad in [("", 3, "cosine", 16, 200), ("a/b", 3, "cosine", 16, 200), ("x" * 257, 3, "cosine", 16, 200), ("d", 0, "cosine", 16, 200), ("d", True, "cosine", 16, 200), ("d", 3, "Cosine", 16, 200), ("d", 3, "cosine", 1, 200), ("d", 3, "cosine", 129, 200), ("d", 3, "cosine", 16, 9), ("d", 3, "cosine", 16, 2001)]:
        with pytest.raises(errors.InvalidConfig):
            validate.check_config(*bad)
    for bad in [{"k": 0}, {"k": True}, {"k": -1}, {"k": 5, "ef": 4}, {"k": 1, "overfetch": 1}, {"k": 1, "strategy": "x"}]:
        with pytest.raises(errors.InvalidSearch):
            validate.check_search(**bad)
    with pytest.raises(NotImplementedError):
        validate.check_search(1, strategy="auto")


def test_classify_order(spark):
    batch = spark.createDataFrame([(0, "a", [1.0, 2.0], None), (1, "a", [1.0, 2.0], None), (2, "b", [1.0], None), (3, "b", [1.0, 2.0], None), (4, "live", [1.0, 2.0], None)], "pos long, id string, vector array<double>, metadata string")
    live = spark.createDataFrame([("live",)], "id string")
    got = {r.pos: r.error for r in oplog.classify(batch, live, 2).collect()}
    assert got == {0: None, 1: "duplicate_id", 2: "wrong_dimension", 3: None, 4: "duplicate_id"}
    assert tuple(oplog.report(oplog.classify(batch, live, 2)).first()) == (2, 3)


def test_diverse_neighbours():
    import numpy as np

    x = np.array([[1.0, 0], [1.1, 0], [0, 1.0], [-3.0, 0]])
    assert ann.diverse(x, np.linalg.norm(x, axis=1), 4) == [0, 2, 3]


def test_recall_and_empty(spark):
    truth = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 2)], "qid long, id long, rank int")
    found = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (2, 99, 1)], "qid long, id long, rank int")
    assert {r.qid: r.recall for r in evaluate.recall(found, truth, 2).collect()} == {1: 1.0, 2: 0.0}
    assert {r.qid: r.recall for r in evaluate.recall(found, truth, 0).collect()} == {1: 1.0, 2: 1.0}


def test_every_group_of_a_graph_is_searched(spark):
    # Cells of a single row have no edge and mostly no upper layer.
    rows = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(30)], "id long, cell int, embedding array<double>")
    groups = ann.grouped(rows)
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 30, 7)], "qid long, q array<double>")
    got = ann.search_graph(groups, ann.build_graph(groups), q, 1, metric="euclidean").collect()
    assert sorted((r.qid, r.id) for r in got) == [(i, i) for i in range(0, 30, 7)]


def test_batch_search_gives_k_of_equal_vectors(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "qid long, q array<double>")
    got = knn.batch(rows, q, 3, "euclidean").collect()
    assert sorted((r.qid, r.id, r["rank"]) for r in got) == [(x, i, i + 1) for x in (1, 2) for i in range(3)]


@pytest.mark.parametrize("kind", ["string", "long", "date"])
@pytest.mark.parametrize("block", [knn.QUERY_BLOCK, 2])
def test_batch_search_where_partitions_and_blocks_have_no_rows(spark, monkeypatch, kind, block):
    monkeypatch.setattr(knn, "PAIR_ROWS", 1)
    ids = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")) if kind == "date" else F.col("n").cast(kind)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "n int, embedding array<float>").withColumn("id", ids).repartition(9)
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "qid long, q array<double>")
    assert 0 in rows.rdd.glom().map(len).collect() and len({r.x for r in rows.select(F.pmod(F.xxhash64("id"), F.lit(5)).alias("x")).collect()}) < 5
    names = {r.n: r.id for r in rows.collect()}
    got = knn.batch(rows, q, 2, "euclidean", block=block).collect()
    assert sorted((r.qid, r["rank"], r.id) for r in got) == [(0, 1, names[0]), (0, 2, names[1]), (1, 1, names[1]), (1, 2, names[0]), (2, 1, names[2]), (2, 2, names[1])]
    assert knn.batch(rows.where("n > 9"), q, 2, "euclidean", block=block).collect() == knn.batch(rows, q.where("qid > 9"), 2, "euclidean", block=block).collect() == []


def test_cells_are_searched_in_blocks(spark, monkeypatch):
    # Many equal vectors, in many blocks and tiles: the lesser ids are found, and k rows at most per query and block are ranked.
    for name, size in (("PAIR_QUERIES", 4), ("PAIR_ROWS", 40), ("TILE", 3), ("PAIRS", 5)):
        monkeypatch.setattr(knn, name, size)
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("cell"), "id", F.array(F.col("id") % 8, F.col("id") % 4, F.lit(1)).cast("array<double>").alias("vector"))
    queries = spark.range(20).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("cell"), F.col("id").alias("qid"), F.array(F.col("id") % 8, F.col("id") % 4, F.lit(1)).cast("array<double>").alias("q"))
    for metric in metrics.HIGHER:
        found = knn.in_cells(rows, queries, 3, metric)
        assert 20 * 3 < found.count() <= 20 * 2 * 3 * 5
        best = knn.Window.partitionBy("qid").orderBy(metrics.best_first(metric), "id")
        got = found.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("qid", "id", "rank")
        scored = rows.join(queries, "cell").select("qid", "id", metrics.score(metric, "vector", "q").alias("score"))
        want = scored.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("qid", "id", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_index_search_ranks_k_rows_of_a_cell(spark, monkeypatch):
    # Not every row of every probed cell, which grows with the square of the data.
    ranked = []
    whole = ann.knn.in_cells
    monkeypatch.setattr(ann.knn, "in_cells", lambda *a: ranked.append(whole(*a)) or ranked[-1])
    rows = spark.range(500).select("id", F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    centres = ann.fit_centres(rows, 4)
    found = ann.search_ivf(ann.build_ivf(rows, centres), centres, rows.where("id < 10").select(F.col("id").alias("qid"), F.col("embedding").alias("q")), 2, 3)
    assert found.count() == 20 and ranked[0].count() == 10 * 3 * 2


def test_centres_are_fitted_on_the_rows_of_least_hash(spark, monkeypatch):
    monkeypatch.setattr(ann, "TRAINED", 30)
    rows = spark.range(200).select("id", F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    least = rows.orderBy(F.xxhash64("id"), "id").limit(30)
    assert (ann.fit_centres(rows, 4) == ann.fit_centres(least, 4)).all()


def test_more_queries_than_a_block_meet_blocks_of_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "PAIR_QUERIES", 7)
    monkeypatch.setattr(knn, "PAIR_ROWS", 30)
    rows = spark.range(100).select(F.concat(F.lit("n"), "id").alias("id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    queries = rows.select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    many, few = (knn.batch(rows, queries, 5, "euclidean", block=n).collect() for n in (10, 1000))
    assert len(many) == 500 and sorted(map(tuple, many)) == sorted(map(tuple, few))
    assert all(r.id == r.qid for r in many if r["rank"] == 1)


def test_memory_of_a_batch_search_is_that_of_a_tile():
    import tracemalloc

    import numpy as np

    q, x = np.random.default_rng(1).random((4096, 8)), np.random.default_rng(2).random((10_000, 8))
    tracemalloc.start()
    qi, ids, score = knn.k_best(q, [(np.arange(10_000), x)], 10, "euclidean")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(qi) == len(ids) == len(score) == 40_960
    assert peak < 100e6  # all scores at once are 328 MB


def test_vectors_that_cannot_be_compared_are_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>")
    for bad in (None, [1.0], [1.0, None]):
        rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "id long, embedding array<double>").coalesce(1)
        with pytest.raises(PySparkException):
            knn.batch(rows, q, 1).collect()


def test_a_graph_is_walked_once_by_group(spark, tmp_path, monkeypatch):
    # Its edges are read once, whatever the rounds, and the walk is the beam written plainly here; some rows are skipped.
    monkeypatch.setattr(ann, "WALKED", 3)
    monkeypatch.setattr(ann.knn, "PAIR_QUERIES", 4)
    rows = ann.grouped(spark.range(120).select("id", (F.col("id") % 2).cast("int").alias("cell"), F.array(F.cos("id"), F.sin("id"), F.cos(F.col("id") * 3)).alias("embedding")))
    links = [(c, i, i + s) for i in range(120) for s in (2, -2, 14) for c in [i % 2] if 0 <= i + s < 120]
    spark.createDataFrame(links, "cell int, node long, other long").select("cell", F.lit(0).cast(dict(rows.dtypes)["shard"]).alias("shard"), "node", "other").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    q = rows.where("id % 11 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    skip = spark.range(0, 120, 5)
    found = ann.search_graph(rows, edges, q, 3, ef=6, m=4, rounds=3, metric="euclidean", entries=2, skip=skip)
    assert found._jdf.queryExecution().analyzed().toString().count("parquet") == 1
    uniform = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    layer = {r.id: r.layer for r in rows.select("id", ann.layer_of(uniform, 4).alias("layer")).collect()}
    v = {r.id: r.embedding for r in rows.collect()}
    near = {}
    for _, a, b in links:
        near.setdefault(a, set()).add(b)
    want = set()
    for qid in range(0, 120, 11):
        cost = lambda i, qid=qid: (math.dist(v[i], v[qid]), i)
        met = []
        for cell in (0, 1):
            seen = set(sorted((i for i in v if i % 2 == cell and layer[i] >= 1), key=cost)[:2])
            beam = seen
            for _ in range(3):
                seen = seen.union(*(near[i] for i in beam))
                beam = sorted(seen, key=cost)[:6]
            met += [i for i in seen if i % 5]
        want |= {(qid, i, n + 1) for n, i in enumerate(sorted(met, key=cost)[:3])}
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == want
