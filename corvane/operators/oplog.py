"""Rows of a collection as a log: puts and deletes by sequence number, read as the latest of each id.

Every entry has a sequence number of its own; of two entries with the same id and number both count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.validate import id_error, metadata_error, vector_error

LOG = "seq long, op string, id string, slot_id long, embedding array<float>, metadata string, created_at timestamp"


def latest(log: DataFrame, id_col: str = "id") -> DataFrame:
    """The last entry of every id, also if it is a delete: one pass, summed up before the shuffle."""
    rest = [c for c in log.columns if c != id_col]
    return log.groupBy(id_col).agg(F.max_by(F.struct(*rest), "seq").alias("last")).select(id_col, "last.*")


def passed(log: DataFrame, id_col: str = "id", *columns: str) -> DataFrame:
    """The puts (id, seq and ``columns``) that a later entry of their id replaced or deleted.

    Only ids and numbers are shuffled, and only ids with several entries are joined back.
    """
    again = log.groupBy(F.col(id_col).alias("again_id")).agg(F.max("seq").alias("last_seq"), F.count("*").alias("entries")).where("entries > 1")
    puts = log.where("op = 'put'").select(id_col, "seq", *columns)
    return puts.join(again, F.col(id_col).eqNullSafe(F.col("again_id"))).where("seq < last_seq").select(id_col, "seq", *columns)


def live(log: DataFrame, id_col: str = "id") -> DataFrame:
    """The puts that nothing came after; vectors stay where they are while the passed ones are few."""
    gone = passed(log, id_col).select(F.col(id_col).alias("gone_id"), F.col("seq").alias("gone_seq"))
    return log.where("op = 'put'").join(gone, (F.col("seq") == F.col("gone_seq")) & F.col(id_col).eqNullSafe(F.col("gone_id")), "left_anti")


def tombstones(log: DataFrame, id_col: str = "id") -> DataFrame:
    """The slots of rows that were put and are no longer live, replaced ones too."""
    return passed(log, id_col, "slot_id").select("slot_id").distinct()


def next_slot(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("slot_id"), F.lit(-1)) + 1).alias("next_slot"))


def numbered(rows: DataFrame, name: str = "n") -> DataFrame:
    """``rows``, which must be stored or checkpointed, with whole numbers from 0 without gaps.

    Only the sizes of the partitions, one row each, are brought together.
    """
    placed = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def classify(batch: DataFrame, live_ids: DataFrame, dimension: int, metric: str = "euclidean", position: str = "pos") -> DataFrame:
    """``batch`` (pos, id, vector, metadata) with ``error``: null for what may be inserted.

    An id must be neither live nor that of a good record before it in the batch.  An error that is
    known already may stand in a column ``given``.
    """
    known = [F.col("given")] if "given" in batch.columns else []
    bad = F.coalesce(*known, id_error(F.col("id")), vector_error(F.col("vector"), dimension, metric), metadata_error(F.col("metadata")))
    checked = batch.withColumn("bad", bad).join(live_ids.select(F.col("id").alias("live_id")).distinct(), F.col("id") == F.col("live_id"), "left")
    order = Window.partitionBy("id", F.col("bad").isNull()).orderBy(position)
    first = F.row_number().over(order)
    error = F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("live_id").isNotNull(), "duplicate_id").when(first > 1, "duplicate_id")
    return checked.withColumn("error", error).drop("bad", "live_id")


def report(classified: DataFrame) -> DataFrame:
    good = F.col("error").isNull().cast("long")
    return classified.agg(F.coalesce(F.sum(good), F.lit(0)).alias("inserted"), F.coalesce(F.sum(1 - good), F.lit(0)).alias("failed"))
