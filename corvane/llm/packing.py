"""Packing documents into sequences: shortest pack first over the histogram of lengths.

A document of n ids is cut into whole sequences and one rest.  Only the histogram of the rests'
lengths reaches the driver (at most ``capacity`` rows, whatever the corpus), where patterns of
lengths are counted.  Documents then meet their pattern by their rank among the rests of their
length; the ranks come from bounded groups, so no length's documents ever meet in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import words as W
from corvane.llm.frames import stored, texts
from corvane.llm.tokens import bpe_pieces

#: Pieces of a length that are ranked in one group, on average.
RANKED = 50_000
#: Groups per length at least, so that a very common length is dealt out in small data too.
GROUPS = 64


def cut(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): pieces of at most ``capacity`` ids of every whole text.

    A null text counts as empty and has the end id alone.  Repeated rows give repeated pieces.
    """

    def run(batches):
        pieces = bpe_pieces(tokenizer)
        for b in (part for batch in batches for part in W.parts(batch)):
            ids, offs = pieces(b.column("text"))
            n = np.diff(offs) + 1
            ids = np.insert(ids, offs[1:], end_id).astype("<u4")
            first = np.concatenate([[0], np.cumsum(n)])
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(capacity, n[doc] - start)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip((first[doc] + start).tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc]))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
        bpe_pieces.cache_clear()  # the worker lives on, and other steps don't need the tokenizer and what it has met

    return texts(docs, key, text).mapInArrow(W.tidied(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (lengths, how often), placing lengths longest first into the emptiest pack that fits.

    Packs alike are one entry with a count; a length with n pieces takes whole entries while n lasts
    and splits the last.  Ties in space go to the pattern made first.
    """
    by_room: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=0)
            if room < length:
                # No open pack fits: packs are opened one by one, each filled before the next.
                fit = capacity // length
                for size, count in ((fit, left // fit), (left % fit, 1)):
                    if size and count:
                        by_room.setdefault(capacity - size * length, []).append([(length,) * size, count])
                break
            pack = by_room[room][0]
            taken = min(left, pack[1])
            left -= taken
            if taken == pack[1]:
                by_room[room].pop(0)
            else:
                pack[1] -= taken
            by_room.setdefault(room - length, []).append([(*pack[0], length), taken])
    return [(tuple(lengths), count) for _, packs in sorted(by_room.items()) for lengths, count in packs]


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with (sequence_id, offset): each lies in one sequence, gapless from offset 0.

    Whole sequences (length ``capacity``) need no partner.  Input rows should be stored, as they are
    read twice.  An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = {r.length: r.n for r in counts if r.length < capacity}
    total = sum(r.n for r in counts)
    groups = max(GROUPS, -(-total // RANKED))
    spans, base = [], 0
    seen = dict.fromkeys(histogram, 0)
    for lengths, count in patterns(histogram, capacity):
        offset = 0
        for length in lengths:
            spans.append((length, seen[length], seen[length] + count, base - seen[length], offset))
            seen[length] += count
            offset += length
        base += count
    spans += [(capacity, 0, 1 << 62, base, 0)]
    # The number of spans depends on the capacity alone: every length splits one entry at most.
    table = spark.createDataFrame(spans, "length long, lo long, hi long, shift long, offset long")
    grouped = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = grouped.groupBy("length", "part").agg(F.count("*").alias("m")).select("length", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = grouped.withColumn("own", F.row_number().over(own)).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    r, t = ranked.alias("r"), F.broadcast(table).alias("t")
    return r.join(t, (F.col("r.length") == F.col("t.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "r.doc_id", "r.start", "r.length", "r.ids_crc32", "r.doc_tokens", (F.col("rank") + F.col("shift")).alias("sequence_id"), F.col("t.offset").alias("offset")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their place in a sequence; see ``cut`` and ``place``."""
    return place(stored(cut(docs, tokenizer, capacity, end_id, key, text), "pieces"), capacity)
