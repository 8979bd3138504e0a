"""Collections on disk: changes, reads, archives, streams."""

import pytest

from corvane import errors
from corvane.sources.catalog import Database, Journal
from corvane.sources.datasets import append_csv, load_bundle, normal_vectors, synthetic
from corvane.streaming.ingest import ingest


@pytest.fixture
def db(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as d:
        yield d


def test_lifecycle(db):
    c = db.create_collection("docs", 2, "euclidean", mode="research", m=8, ef_construction=100)
    assert db.get_collection("docs") is c and db.list_collections() == ["docs"] and c.count() == 0
    with pytest.raises(errors.EmptyCollection):
        c.search([0.0, 0.0], 1)
    c.insert("a", [0.0, 0.0], {"year": 2024})
    got = c.batch_insert([{"id": "b", "vector": [1.0, 0.0], "metadata": {"year": 2020}}, {"id": "a", "vector": [1.0, 1.0]}, {"id": "c", "vector": [1.0]}, {"vector": [1.0, 1.0]}, {"id": "d", "vector": [5.0, 5.0], "metadata": {"year": "2020"}}])
    assert (got["inserted"], got["failed"]) == (2, 3)
    assert {r.id: r.error for r in got["errors"].collect()} == {"a": "duplicate_id", "c": "wrong_dimension", "<missing>": "null_id"}
    assert [r.id for r in c.search([0.0, 0.0], 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.id for r in c.search([0.0, 0.0], 5, filters={"year": {"lt": 2024}}).collect()] == ["b"]
    c.delete("a")
    with pytest.raises(errors.NotFound):
        c.delete("a")
    assert [r.id for r in c.search([0.0, 0.0], 1).collect()] == ["b"]
    c.insert("a", [0.1, 0.0])
    c.update("b", metadata={"year": 1999})
    assert c.get("b") == {"id": "b", "vector": [1.0, 0.0], "metadata": {"year": 1999}}
    with pytest.raises(errors.InvalidVector):
        c.update("b", vector=[1.0])
    assert c.get("b")["vector"] == [1.0, 0.0]
    assert c.count() == 3 and c.check_integrity().count() == 0
    c.compact()
    assert [r.id for r in c.ids().collect()] == ["a", "b", "d"] and len(c.versions()) == 1


def test_reopen_archive_and_delete(db, spark, tmp_path):
    c = db.create_collection("one", 2)
    c.insert("x", [1.0, 0.0], {"k": [1, {"a": None}]})
    again = Database(spark, db.root).get_collection("one")
    assert again.config == c.config and again.get("x")["metadata"] == {"k": [1, {"a": None}]}
    c.export_archive(str(tmp_path / "arc"))
    two = db.import_archive(str(tmp_path / "arc"), "two")
    assert two.count() == 1 and two.config.name == "two"
    with pytest.raises(errors.ArchiveError):
        db.import_archive(str(tmp_path), "three")
    db.delete_collection("one")
    with pytest.raises(errors.NotFound):
        db.get_collection("one")


def test_bad_collections_leave_nothing(db):
    for kw in [{"metric": "x"}, {"dimension": 0}, {"mode": "x"}, {"m": 4}]:
        with pytest.raises(errors.InvalidConfig):
            db.create_collection("bad", **({"dimension": 2} | kw))
    assert db.list_collections() == []
    db.create_collection("ok", 2)
    with pytest.raises(errors.AlreadyExists):
        db.create_collection("ok", 2)


def test_journal(spark, tmp_path):
    j = Journal(spark, str(tmp_path))
    run = j.start_run("r", "begin")
    j.end_run(run)
    j.end_run(j.start_run("r"), "done")
    got = sorted((r.take, r.notes, r.ended_at is not None) for r in j.runs().collect())
    assert got == [(1, "begin", True), (2, "done", True)]


def test_stream(db, spark, tmp_path):
    c = db.create_collection("s", 2, "dot")
    rows = spark.createDataFrame([("a", [1.0, 2.0], "{}"), ("b", [1.0, 2.0], "{}"), ("a", [1.0, 2.0], "{}")], "id string, vector array<double>, metadata string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert c.count() == 2


def test_bad_records_of_a_list_fail_by_themselves(db):
    c = db.create_collection("r", 2, "dot")
    got = c.batch_insert([
        {"id": "a", "vector": [1, 2]}, {"id": 7, "vector": [1, 2]}, {"id": "b", "vector": ["x", 2]}, {"id": "c", "vector": [[1.0, 2.0]]},
        {"id": "d", "vector": [1, 2], "metadata": {"f": object()}}, {"id": "e", "vector": 5}, "text", {"id": "g", "vector": [3, 4]},
    ])
    assert (got["inserted"], got["failed"]) == (2, 6)
    assert {r.pos: r.error for r in got["errors"].collect()} == {1: "id_not_a_string", 2: "not_numeric", 3: "two_dimensional", 4: "metadata_not_serialisable", 5: "not_numeric", 6: "not_a_record"}
    with pytest.raises(errors.InvalidVector, match="one row"):
        c.insert("h", [[1.0, 2.0]])
    with pytest.raises(errors.InvalidId):
        c.insert(3, [1.0, 2.0])
    assert c.count() == 2


def test_numbers_and_slots_have_no_gaps_and_go_on(db, spark):
    c = db.create_collection("n", 2, "dot")
    rows = spark.range(40).selectExpr("CAST(id AS STRING) AS id", "array(1.0D, CAST(id AS DOUBLE)) AS vector", "'x' AS given", "'{}' AS metadata").repartition(5)
    assert c.batch_insert(rows)["inserted"] == 40
    assert sorted(r.slot_id for r in c.rows().collect()) == list(range(40)) == sorted(r.seq for r in c.rows().collect())
    c.delete(c.rows().where("slot_id = 39").first().id)
    c.compact()
    c.insert("new", [1.0, 1.0])
    assert c.rows().where("id = 'new'").first().slot_id == 40 and c.check_integrity().isEmpty()


def test_of_two_writers_one_wins(db, spark):
    one = db.create_collection("w", 2, "dot")
    two = Database(spark, db.root).get_collection("w")
    number, state = two._state()
    one.insert("a", [1.0, 2.0])
    with pytest.raises(errors.Conflict):
        two._commit(number, state)
    assert two.count() == 1 and not [n for n in db.files.names(f"{one.path}/state") if n.endswith(".tmp")]


def test_damage_is_seen_on_open(db, spark):
    c = db.create_collection("x", 2, "dot")
    c.insert("a", [1.0, 2.0])
    db.files.delete(f"{c.path}/log/{c.versions()[0]}")
    with pytest.raises(errors.IntegrityError):
        Database(spark, db.root).get_collection("x")
    db.create_collection("y", 2, "dot")
    db.files.delete(f"{db.root}/y/manifest.json")
    db.files.create(f"{db.root}/y/manifest.json", '{"name": "y", "dimension": 0}')
    with pytest.raises(errors.IntegrityError):
        Database(spark, db.root).get_collection("y")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_index_of_a_collection(db, spark, metric):
    c = db.create_collection("i", 8, metric)
    bundle = synthetic(spark, 600, 1, 8)
    query = bundle.test.first().q
    c.batch_insert(bundle.train.selectExpr("CAST(id AS STRING) AS id", "embedding AS vector"))
    with pytest.raises(errors.InvalidSearch):
        c.search(query, 10, approximate=True)
    c.build_index()
    found = lambda **kw: [r.id for r in c.search(query, 10, **kw).orderBy("rank").collect()]
    truth = found()
    assert len(set(truth) & set(found(approximate=True))) >= 9
    for gone in truth[:3]:
        c.delete(gone)
    c.update(truth[3], vector=[-x for x in query])
    c.insert("late", query)
    truth, got = found(), found(approximate=True)
    assert got[0] == "late" and len(set(truth) & set(got)) >= 9 and len(got) == 10
    again = Database(spark, db.root).get_collection("i")
    assert [r.id for r in again.search(query, 10, approximate=True).orderBy("rank").collect()] == got


def test_bundles_and_csv(spark, tmp_path):
    bundle = synthetic(spark, 1500, 3, 4, k=5, metric="euclidean")
    bundle.save(str(tmp_path / "b"))
    back = load_bundle(spark, str(tmp_path / "b"))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(back.train) == rows(bundle.train) and rows(back.neighbors) == rows(bundle.neighbors) and back.train.count() == 1500
    few = load_bundle(spark, str(tmp_path / "b"), 100, 2, 5, "euclidean")
    assert few.neighbors.count() == 10 and few.neighbors.where("id >= 100").isEmpty()
    assert rows(normal_vectors(spark, 1100, 4)) == rows(bundle.train.where("id < 1100"))
    for n in (1, 2):
        append_csv(spark.createDataFrame([("run", n)], "name string, n int"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == [("run", "1"), ("run", "2")]
