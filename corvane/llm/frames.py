"""Small helpers shared by the operators: their input columns and what they store in the shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key and the text; other columns, whatever their names, stay out of the operators."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def sifted(docs: DataFrame, verdict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of which ``verdict`` (ids, texts) of a batch says true.

    A row goes through Python once and as it is, so that its text isn't held twice.
    """
    from corvane.llm import words as W

    def run(batches):
        for b in (part for batch in batches for part in W.parts(batch, text)):
            yield b.filter(verdict(b.column(key), b.column(text)))

    return docs.mapInArrow(W.tidied(run), docs.schema)


@cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, path, True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a folder of our own stands in, but only in local mode: on a cluster, executors
    wouldn't see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder then stays with the cluster's own
        pass


class Scratch:
    """What one call of an operator stores; nobody else's ``drop`` touches it.

    Without a ``drop`` it stays until the program ends, as DataFrames that nobody has written yet may
    read it.  ``with`` drops it at the end of the block, by which time its readers must be written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self.drop)

    def path(self, what: str) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/corvane/{what}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def store(self, df: DataFrame, what: str) -> DataFrame:
        """The rows written to the shared folder and read back: cuts lineage, survives lost executors."""
        path = self.path(what)
        df.write.option("compression", "zstd").parquet(path)
        # Spark removes shuffle files when the driver collects what refers to them, which may be never.
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            _remove(self.spark, path)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows in a scratch of their own, which stays until the program ends."""
    return Scratch(df.sparkSession).store(df, what)
