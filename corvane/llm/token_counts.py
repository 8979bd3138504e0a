"""Token counts of documents in flat token files, by scanning for end-of-document ids.

A flat file is nothing but fixed-width little-endian ids; there is no index.  Files are read as
blocks; each block finds its separators with one vectorised comparison, and what runs over a block's
edge is put together by a running maximum over the blocks of the file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.frames import texts
from corvane.llm.tokens import rank_encoding, rank_pieces

SUMMARY = "file long, block long, n_ids long, seps array<long>, tags array<long>"


def id_width(ranks: str, pattern: str, end_id: int) -> int:
    """Bytes of an id in a flat file; raises ValueError if ``end_id`` is a rank itself."""
    known = set(rank_encoding(ranks, pattern)[1].values())
    if end_id in known or end_id < 0:
        raise ValueError(f"{end_id} is a token's rank, so it can't end documents")
    return 2 if max(end_id, *known) < 1 << 16 else 4


def token_blocks(docs: DataFrame, ranks: str, pattern: str, end_id: int, block_ids: int = 1 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(file, block, data, tags): the flat token stream of each input partition, cut into blocks anywhere.

    Every document's ids are followed by ``end_id``, which must not be a rank.  Ids take two bytes if
    all ranks and ``end_id`` fit, else four (see ``id_width``).  ``tags`` is the writer's log: the ids
    of the documents that end in a block, in order.  A null text counts as empty; repeated rows, and
    rows without an id, are documents like any other.
    """
    width = id_width(ranks, pattern, end_id)

    def run(batches):
        from pyspark import TaskContext

        pieces, file = rank_pieces(ranks, pattern), TaskContext.get().partitionId()
        dtype = f"<u{width}"
        held, ends, tags, block = [], [], [], 0
        size = 0

        def emit(last=False):
            nonlocal held, ends, tags, block, size
            ids = np.concatenate(held) if held else np.zeros(0, dtype)
            where, names = np.array(ends, np.int64), tags
            done = 0
            while len(ids) - done >= block_ids or last and done < len(ids):
                stop = min(done + block_ids, len(ids))
                a, b = np.searchsorted(where, [done, stop])
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([ids[done:stop].tobytes()], pa.binary()), pa.array([names[a:b]], pa.list_(pa.int64()))], ["file", "block", "data", "tags"])
                block, done = block + 1, stop
            a = int(np.searchsorted(where, done))
            held, ends, tags, size = [ids[done:]], (where[a:] - done).tolist(), names[a:], len(ids) - done

        for b in batches:
            ids, offs = pieces(b.column("text"))
            full = np.insert(ids, offs[1:], end_id).astype(dtype)
            stops = offs[1:] + np.arange(len(offs) - 1)
            ends.extend((stops + size).tolist())
            tags.extend(b.column("doc_id").to_pylist())
            held.append(full)
            size += len(full)
            if size >= block_ids:
                yield from emit()
        yield from emit(True)

    return texts(docs, key, text).mapInArrow(run, "file long, block long, data binary, tags array<long>")


def file_blocks(spark: SparkSession, path: str, block_ids: int = 1 << 20, width: int = 2) -> DataFrame:
    """Blocks of the flat token files under ``path``, through Spark's own reader (files up to 2 GB each)."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "path", "content")
    step = block_ids * width
    count = F.ceil(F.length("content") / F.lit(step)).cast("int")
    blocks = files.withColumn("block", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    return blocks.select("file", "path", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, block * {step} + 1, {step})").alias("data"), F.array().cast("array<long>").alias("tags"))


def scan(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, doc_no, n_tokens, tag, ended): one row per document of every file, in file order.

    ``n_tokens`` counts the ids before the separator.  Ids after a file's last separator are a
    document that isn't ended (ended false), if there are any.  ``tag`` is the writer's name for the
    document, null where the blocks carry none.  Blocks of null or no data add nothing.
    """

    def run(batches):
        dtype = {2: "<u2", 4: "<u4"}[width]
        for b in batches:
            seps, n = [], []
            for x in b.column("data"):
                ids = np.frombuffer(x.as_py() or b"", dtype)
                seps.append(np.flatnonzero(ids == end_id))
                n.append(len(ids))
            at = np.cumsum([0, *map(len, seps)])
            flat = pa.array(np.concatenate([*seps, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), b.column("tags")], ["file", "block", "n_ids", "seps", "tags"])

    found = blocks.select("file", "block", "data", "tags").mapInArrow(run, SUMMARY)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("seps") > 0, F.element_at("seps", -1))
    placed = found.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    carried = placed.withColumn("open", F.coalesce(F.max(F.col("base") + last).over(before) + 1, F.lit(0))).withColumn("docs", F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)))
    final = Window.partitionBy("file").orderBy(F.desc("block"))
    carried = carried.withColumn("is_last", F.row_number().over(final) == 1)
    ends = F.transform("seps", lambda x: x + F.col("base"))
    starts = F.concat(F.array("open"), F.transform("seps", lambda x: x + F.col("base") + 1))
    tail = F.col("is_last") & (F.element_at(starts, -1) < F.col("base") + F.col("n_ids"))
    rows = carried.select("file", "docs", "tags", tail.alias("tail"), starts.alias("starts"), F.when(tail, F.concat(ends, F.array(F.col("base") + F.col("n_ids")))).otherwise(ends).alias("ends"))
    each = rows.select("file", "docs", "tags", "tail", "starts", "ends", F.posexplode("ends").alias("k", "stop"))
    return each.select(
        "file", (F.col("docs") + F.col("k")).alias("doc_no"), (F.col("stop") - F.get("starts", "k")).alias("n_tokens"), F.get("tags", "k").alias("tag"), (~(F.col("tail") & (F.col("k") == F.size("ends") - 1))).alias("ended")
    )
