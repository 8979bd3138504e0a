"""Databases and collections: a manifest and an append-only log in Parquet, read as snapshots.

A collection's folder has ``manifest.json``, ``log/<version>`` folders, and numbered files in
``state``: the one with the highest number lists the versions that count, the next sequence number
and slot, and the index.  A write adds a folder under a name of its own, then creates the next state
file, so readers always see one whole state, and of two writers one gets ``Conflict``.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import errors
from corvane.functions.filters import parse_filter
from corvane.functions.metrics import best_first, normalized
from corvane.functions.validate import check_config, check_search
from corvane.operators import ann, evaluate, knn, oplog
from corvane.sources.files import Files

VERSION = "0.1.0"
BEGINNER_EF = 100
#: State files that are kept, so that readers who have just listed them still find theirs.
KEPT_STATES = 20
LOG_COLUMNS = [c.split()[0] for c in oplog.LOG.split(", ")]


def _folder(number: int) -> str:
    return f"{number:06d}-{uuid.uuid4().hex[:12]}"


def _record(position: int, record) -> tuple:
    """(pos, id, vector, metadata, given) of a record of a list, ``given`` being what is wrong with its types."""
    if not isinstance(record, dict):
        return position, None, None, None, "not_a_record"
    id_, vector, metadata, error = record.get("id"), record.get("vector"), record.get("metadata"), None
    if id_ is not None and not isinstance(id_, str):
        id_, error = str(id_), "id_not_a_string"
    try:
        if vector is not None:
            vector = list(vector)
            if any(hasattr(x, "__len__") and not isinstance(x, str) for x in vector):
                vector, error = None, error or "two_dimensional"
            elif any(isinstance(x, (str, bytes)) for x in vector):
                raise TypeError("text in a vector")
            else:
                vector = [None if x is None else float(x) for x in vector]
    except (TypeError, ValueError, OverflowError):
        vector, error = None, error or "not_numeric"
    try:
        metadata = None if metadata is None else json.dumps(metadata)
    except (TypeError, ValueError, RecursionError):
        metadata, error = None, error or "metadata_not_serialisable"
    return position, id_, vector, metadata, error


RECORD = "pos long, id string, vector array<double>, metadata string, given string"


@dataclass(frozen=True)
class Config:
    name: str
    dimension: int
    metric: str
    m: int
    ef_construction: int
    mode: str
    created_at: str
    version: str = VERSION


class Lock:
    """One writer per collection in this process; may be taken again by its holder."""

    def __init__(self):
        self._lock = threading.RLock()

    @contextmanager
    def acquire(self, operation: str, timeout: float = 5.0):
        if not self._lock.acquire(timeout=timeout):
            raise errors.LockTimeout(f"no lock for {operation} within {timeout} s")
        try:
            yield
        finally:
            self._lock.release()


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.files.make(self.root)
        self._open: dict[str, Collection] = {}

    def create_collection(self, name: str, dimension: int, metric: str = "cosine", mode: str = "beginner", m: int | None = None, ef_construction: int | None = None) -> Collection:
        if mode not in ("beginner", "research"):
            raise errors.InvalidConfig(f"unknown mode {mode!r}")
        if mode == "beginner" and (m is not None or ef_construction is not None):
            raise errors.InvalidConfig("m and ef_construction are fixed in beginner mode")
        m, ef_construction = 16 if m is None else m, 200 if ef_construction is None else ef_construction
        check_config(name, dimension, metric, m, ef_construction)
        if self.exists(name):
            raise errors.AlreadyExists(name)
        config = Config(name, dimension, metric, m, ef_construction, mode, datetime.now(UTC).isoformat())
        self._begin(name, asdict(config), {"versions": [], "seq": 0, "slot": 0, "index": None})
        return self.get_collection(name)

    def _begin(self, name: str, manifest: dict, state: dict) -> None:
        """The first state, then the manifest, which makes the collection exist."""
        self.files.make(f"{self.root}/{name}/log")
        self.files.make(f"{self.root}/{name}/state")
        number = len(self.files.names(f"{self.root}/{name}/state"))
        self.files.create(f"{self.root}/{name}/state/{number:012d}.json", json.dumps(state))
        if not self.files.create(f"{self.root}/{name}/manifest.json", json.dumps(manifest)):
            raise errors.AlreadyExists(name)

    def exists(self, name: str) -> bool:
        return self.files.exists(f"{self.root}/{name}/manifest.json")

    def get_collection(self, name: str) -> Collection:
        if name not in self._open:
            if not self.exists(name):
                raise errors.NotFound(name)
            self._open[name] = Collection(self, name)
        return self._open[name]

    def delete_collection(self, name: str) -> None:
        if not self.exists(name):
            raise errors.NotFound(name)
        self._open.pop(name, None)
        self.files.delete(f"{self.root}/{name}")

    def list_collections(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.exists(n)]

    def close(self) -> None:
        self._open.clear()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def import_archive(self, path: str, name: str) -> Collection:
        """A collection from a folder written by ``Collection.export_archive``."""
        if not self.files.exists(f"{path}/manifest.json") or not self.files.exists(f"{path}/rows"):
            raise errors.ArchiveError(f"{path} isn't a whole archive")
        if self.exists(name):
            raise errors.AlreadyExists(name)
        old = json.loads(self.files.read(f"{path}/manifest.json"))
        version = _folder(1)
        rows = self.spark.read.schema(oplog.LOG).parquet(f"{path}/rows")
        rows.write.parquet(f"{self.root}/{name}/log/{version}")
        seq, slot, n = rows.agg(F.coalesce(F.max("seq") + 1, F.lit(0)), F.coalesce(F.max("slot_id") + 1, F.lit(0)), F.count("*")).first()
        if n != old.pop("rows", n):
            raise errors.ArchiveError(f"{path} has {n} rows, not those of its manifest")
        self._begin(name, old | {"name": name}, {"versions": [version], "seq": seq, "slot": slot, "index": None})
        return self.get_collection(name)


class Collection:
    def __init__(self, db: Database, name: str):
        self.db, self.spark, self.path, self.lock = db, db.spark, f"{db.root}/{name}", Lock()
        try:
            self.config = Config(**json.loads(db.files.read(f"{self.path}/manifest.json")))
            check_config(*(getattr(self.config, f) for f in ("name", "dimension", "metric", "m", "ef_construction")))
        except (TypeError, ValueError) as e:
            raise errors.IntegrityError(f"{name} has a bad manifest: {e}") from e
        if self.config.name != name:
            raise errors.IntegrityError(f"the manifest of {name} is that of {self.config.name}")
        for version in self.versions():
            if not db.files.exists(f"{self.path}/log/{version}"):
                raise errors.IntegrityError(f"{name} has lost its log {version}")

    # State.

    def _state(self) -> tuple[int, dict]:
        names = [n for n in self.db.files.names(f"{self.path}/state") if n.endswith(".json")]
        if not names:
            raise errors.IntegrityError(f"{self.path} has no state")
        return int(names[-1].removesuffix(".json")), json.loads(self.db.files.read(f"{self.path}/state/{names[-1]}"))

    def _commit(self, number: int, state: dict) -> None:
        """Makes ``state`` the one after ``number``, or raises ``Conflict`` if another writer has done so."""
        if not self.db.files.create(f"{self.path}/state/{number + 1:012d}.json", json.dumps(state)):
            raise errors.Conflict(f"another writer changed {self.config.name}; nothing was written")
        for n in [n for n in self.db.files.names(f"{self.path}/state") if n.endswith(".json")][:-KEPT_STATES]:
            self.db.files.delete(f"{self.path}/state/{n}")

    def versions(self) -> list[str]:
        return self._state()[1]["versions"]

    def _log(self, versions: list[str]) -> DataFrame:
        paths = [f"{self.path}/log/{v}" for v in versions]
        return self.spark.read.schema(oplog.LOG).parquet(*paths) if paths else self.spark.createDataFrame([], oplog.LOG)

    def log(self) -> DataFrame:
        return self._log(self.versions())

    def rows(self) -> DataFrame:
        """The live rows."""
        return oplog.live(self.log())

    def _append(self, entries: DataFrame, number: int, state: dict, puts: int) -> str:
        """Writes ``entries``, which use one number each and ``puts`` slots; the new version."""
        version = _folder(number + 1)
        entries.select(*LOG_COLUMNS).write.parquet(f"{self.path}/log/{version}")
        self._commit(number, state | {"versions": [*state["versions"], version], "seq": state["seq"] + max(puts, 1), "slot": state["slot"] + puts})
        return version

    # Changes.

    def batch_insert(self, records: DataFrame | list[dict], timeout: float = 5.0) -> dict:
        """Inserts the good records; {"inserted", "failed", "errors"}, errors being a DataFrame (pos, id, error)."""
        if not isinstance(records, DataFrame):
            records = self.spark.createDataFrame([_record(k, r) for k, r in enumerate(records)], RECORD)
        else:
            add = {"pos": F.monotonically_increasing_id(), "metadata": F.lit(None).cast("string")}
            records = records.select(*(F.col(c) if c in records.columns else add[c].alias(c) for c in ("pos", "id", "vector", "metadata")))
        with self.lock.acquire("batch_insert", timeout):
            number, state = self._state()
            judged = oplog.classify(records, self.rows().select("id"), self.config.dimension, self.config.metric)
            judged = judged.checkpoint() if self.spark.sparkContext.getCheckpointDir() else judged.persist()
            counts = oplog.report(judged).first()
            version = _folder(number + 1)
            failed = judged.where("error is not null").select("pos", F.coalesce("id", F.lit("<missing>")).alias("id"), "error")
            failed.write.parquet(f"{self.path}/errors/{version}")
            if counts.inserted:
                good = oplog.numbered(judged.where("error is null"))
                self._append(good.select((F.lit(state["seq"]) + F.col("n")).alias("seq"), F.lit("put").alias("op"), "id", (F.lit(state["slot"]) + F.col("n")).alias("slot_id"), F.col("vector").cast("array<float>").alias("embedding"), "metadata", F.current_timestamp().alias("created_at")), number, state, counts.inserted)
            judged.unpersist()
        return {"inserted": counts.inserted, "failed": counts.failed, "errors": self.spark.read.parquet(f"{self.path}/errors/{version}")}

    def insert(self, id: str, vector: list[float], metadata: dict | None = None) -> str:
        got = self.batch_insert([{"id": id, "vector": vector, "metadata": metadata}])
        if got["failed"]:
            error = got["errors"].first().error
            if error == "two_dimensional":
                raise errors.InvalidVector("the vector has rows of its own; pass one row, such as vector[0]")
            raise errors.AlreadyExists(id) if error == "duplicate_id" else errors.InvalidId(error) if error.endswith("_id") or error in ("bad_character", "id_not_a_string") else errors.InvalidMetadata(error) if "metadata" in error else errors.InvalidVector(error)
        return id

    def get(self, id: str) -> dict:
        row = self.rows().where(F.col("id") == id).first()
        if row is None:
            raise errors.NotFound(id)
        return {"id": row.id, "vector": row.embedding, "metadata": json.loads(row.metadata) if row.metadata else {}}

    def update(self, id: str, vector: list[float] | None = None, metadata: dict | None = None) -> None:
        """Replaces the vector, the metadata, or both; what is None stays."""
        with self.lock.acquire("update"):
            old = self.get(id)
            if vector is None and metadata is None:
                return
            row = self.spark.createDataFrame([_record(0, {"id": id, "vector": old["vector"] if vector is None else vector, "metadata": old["metadata"] if metadata is None else metadata})], RECORD)
            judged = oplog.classify(row, self.rows().select("id").limit(0), self.config.dimension, self.config.metric).first()
            if judged.error:
                raise (errors.InvalidMetadata if "metadata" in judged.error else errors.InvalidVector)(judged.error)
            number, state = self._state()
            self._append(row.select(F.lit(state["seq"]).alias("seq"), F.lit("put").alias("op"), "id", F.lit(state["slot"]).alias("slot_id"), F.col("vector").cast("array<float>").alias("embedding"), "metadata", F.current_timestamp().alias("created_at")), number, state, 1)

    def delete(self, id: str) -> None:
        with self.lock.acquire("delete"):
            self.get(id)
            number, state = self._state()
            self._append(self.spark.createDataFrame([(state["seq"], "del", id, None, None, None, None)], oplog.LOG), number, state, 0)

    def compact(self) -> None:
        """Rewrites the log as its live rows; earlier versions are removed, numbers and slots go on."""
        with self.lock.acquire("compact"):
            number, state = self._state()
            if state["versions"]:
                version = _folder(number + 1)
                oplog.live(self._log(state["versions"])).select(*LOG_COLUMNS).write.parquet(f"{self.path}/log/{version}")
                self._commit(number, state | {"versions": [version]})
                for v in state["versions"]:
                    self.db.files.delete(f"{self.path}/log/{v}")

    def build_index(self) -> None:
        """Stores a graph of the live rows next to the log; rows put later are searched exactly until the next build."""
        with self.lock.acquire("build_index"):
            number, state = self._state()
            name = _folder(number + 1)
            rows = oplog.live(self._log(state["versions"])).select(F.col("slot_id").alias("id"), "embedding", F.lit(0).alias("cell"))
            path = f"{self.path}/index/{name}"
            ann.grouped(rows).write.parquet(f"{path}/rows")
            stored = self.spark.read.parquet(f"{path}/rows")
            # Cosine ranks unit vectors as their distances do, so the links are those of unit vectors.
            shaped = stored.withColumn("embedding", normalized("embedding")) if self.config.metric == "cosine" else stored
            ann.build_graph(shaped, self.config.m, self.config.ef_construction).write.parquet(f"{path}/edges")
            self._commit(number, state | {"index": {"name": name, "slot": state["slot"]}})
            if state["index"]:
                self.db.files.delete(f"{self.path}/index/{state['index']['name']}")

    # Reads.

    def count(self) -> int:
        return self.rows().count()

    def count_all(self) -> int:
        return self.log().where("op = 'put'").select("slot_id").distinct().count()

    def ids(self) -> DataFrame:
        return self.rows().select("id").orderBy("id")

    def search(self, query: list[float], k: int = 10, ef: int | None = None, filters: dict | None = None, strategy: str = "pre", overfetch: int = 3, include_vectors: bool = False, approximate: bool = False) -> DataFrame:
        """(id, score, rank, metadata[, embedding]) of the k best live rows.

        ``approximate`` takes the graph of ``build_index`` with a beam of ``ef``; what was put since is
        searched exactly, and what was deleted or replaced is left out.  Filtered searches are exact.
        """
        ef = BEGINNER_EF if self.config.mode == "beginner" and ef is None else ef if ef is not None else max(k, 100)
        check_search(k, ef, overfetch, strategy)
        if len(query) != self.config.dimension:
            raise errors.InvalidVector(f"the query has {len(query)} dimensions, not {self.config.dimension}")
        state = self._state()[1]
        log = self._log(state["versions"])
        rows = oplog.live(log)
        if rows.isEmpty():
            raise errors.EmptyCollection(self.config.name)
        columns = ["id", "score", "rank", "metadata", *(["embedding"] if include_vectors else [])]
        if approximate and not filters:
            if not state["index"]:
                raise errors.InvalidSearch("there is no index yet; call build_index")
            return self._search_index(state["index"], log, rows, [float(x) for x in query], k, ef).select(*columns)
        condition = parse_filter(filters, F.try_parse_json("metadata")) if filters else F.lit(True)
        if filters and strategy == "post":
            found = knn.postfilter(rows, condition, query, k, self.config.metric, overfetch, warn=True)
        else:
            found = knn.prefilter(rows, condition, query, k, self.config.metric)
        return found.select(*columns)

    def _search_index(self, index: dict, log: DataFrame, rows: DataFrame, query: list[float], k: int, ef: int) -> DataFrame:
        path = f"{self.path}/index/{index['name']}"
        groups, edges = self.spark.read.parquet(f"{path}/rows"), self.spark.read.parquet(f"{path}/edges")
        gone = groups.select("id").join(rows.select(F.col("slot_id").alias("id")), "id", "left_anti")
        q = self.spark.createDataFrame([(0, query)], "qid long, q array<double>")
        old = ann.search_graph(groups, edges, q, k, ef, self.config.m, metric=self.config.metric, skip=gone).select(F.col("id").alias("slot_id"), "score")
        new = knn.search(rows.where(F.col("slot_id") >= index["slot"]), query, k, self.config.metric, id_col="slot_id").select("slot_id", "score")
        # At most 2 k hits, so the rows of the log stay where they are; a slot has one put.
        hits = log.where("op = 'put'").join(F.broadcast(old.unionByName(new)), "slot_id")
        best = hits.orderBy(best_first(self.config.metric), "id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(best_first(self.config.metric), "id")))

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return knn.batch(self.rows(), queries, k, self.config.metric)

    def estimate_memory(self, n: int) -> dict:
        return evaluate.estimate_memory(n, self.config.dimension, self.config.m)

    def check_integrity(self) -> DataFrame:
        """(problem, id): live rows that break the schema's rules; none in a sound collection."""
        rows = self.rows()
        bad = F.when(F.col("embedding").isNull(), "no_vector").when(F.size("embedding") != self.config.dimension, "wrong_dimension").when(F.col("slot_id").isNull(), "no_slot")
        twice = rows.groupBy("slot_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select(F.lit("slot_used_twice").alias("problem"), "id")
        state = self._state()[1]
        beyond = self.log().where((F.col("seq") >= state["seq"]) | (F.col("slot_id") >= state["slot"])).select(F.lit("beyond_state").alias("problem"), "id")
        return rows.select(bad.alias("problem"), "id").where("problem is not null").unionByName(twice).unionByName(beyond)

    def export_archive(self, path: str) -> None:
        if self.db.files.exists(path):
            raise errors.ArchiveError(f"{path} exists")
        self.rows().select(*LOG_COLUMNS).write.parquet(f"{path}/rows")
        n = self.spark.read.parquet(f"{path}/rows").count()
        self.db.files.create(f"{path}/manifest.json", json.dumps(asdict(self.config) | {"rows": n}))


class Journal:
    """Runs, log lines and fixes as append-only Parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _add(self, table: str, schema: str, *row) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def start_run(self, name: str, notes: str | None = None) -> str:
        run = f"{name}-{time.time_ns()}"
        self._add("runs", "run string, name string, event string, notes string, at timestamp", run, name, "start", notes, datetime.now(UTC))
        return run

    def end_run(self, run: str, notes: str | None = None) -> None:
        self._add("runs", "run string, name string, event string, notes string, at timestamp", run, None, "end", notes, datetime.now(UTC))

    def write_log(self, level: str, message: str) -> None:
        self._add("logs", "level string, message string, at timestamp", level, message, datetime.now(UTC))

    def record_fix(self, problem: str, fix: str) -> None:
        self._add("fixes", "problem string, fix string, at timestamp", problem, fix, datetime.now(UTC))

    def runs(self) -> DataFrame:
        """A row per run: its take among runs of its name, when it began and ended, its latest notes."""
        rows = self.spark.read.parquet(f"{self.root}/runs")
        one = rows.groupBy("run").agg(F.first("name", True).alias("name"), F.min("at").alias("started_at"), F.max(F.when(F.col("event") == "end", F.col("at"))).alias("ended_at"), F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("at"))).alias("notes"))
        return one.withColumn("take", F.row_number().over(Window.partitionBy("name").orderBy("started_at")))
