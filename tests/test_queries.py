"""Every registered query of the vector engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from corvane.operators import ann, evaluate, knn
from corvane.plans import oracles, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(float(x), 5) + 0.0 if type(x).__name__ in ("float", "Decimal") else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir), duck.sql(oracles.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name,metric", [("ivf_search", "cosine"), ("hnsw_search", "euclidean")])
def test_recall_of_approximate_search(spark, sf_dir, name, metric):
    truth = knn.batch(queries.vectors(spark, sf_dir), queries.probes(spark, sf_dir), 10, metric)
    found = queries.QUERIES[name](spark, sf_dir)
    assert evaluate.recall(found, truth, 10).agg({"recall": "avg"}).first()[0] >= 0.9


def test_every_query_but_those_has_sql():
    assert set(queries.QUERIES) - set(oracles.ORACLES) == {"select_neighbors_heuristic", "ivf_search", "hnsw_search"}


def test_recall_of_a_graph_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 100)
    sf = "/root/testdata/sf0.1"
    truth = knn.batch(queries.vectors(spark, sf), queries.probes(spark, sf), 10, "euclidean")
    assert evaluate.recall(queries.QUERIES["hnsw_search"](spark, sf), truth, 10).agg({"recall": "avg"}).first()[0] >= 0.9


def test_neighbours_and_audit_take_every_row(spark, sf_dir, monkeypatch):
    n = queries.vectors(spark, sf_dir).count()
    assert queries.QUERIES["select_neighbors_heuristic"](spark, sf_dir).select("node").distinct().count() == n
    seen = []
    problems = evaluate.graph_problems
    monkeypatch.setattr(evaluate, "graph_problems", lambda edges, *rest: seen.append(edges) or problems(edges, *rest))
    found = queries.graph_audit(spark, sf_dir, 0)
    assert seen[0].select("node").distinct().count() == n == found.where("problem = 'degree'").count()
    assert found.where("problem <> 'degree'").count() == 0
