"""Asking about keys across a corpus without moving its texts.

The corpus is packed into chunks, each a row that stands for a few MB of text.  Chunks are stored
once, bucketed by their number, and what is learned about a chunk's keys is stored in a table with
the same buckets; so every later pass meets both again without a shuffle.  In a pass every chunk
derives its distinct 64-bit keys, each with some numbers; only these go to the shuffle, as sorted
differences, dealt out evenly by key.  What a chunk gets back has its keys' order, and so needs no
keys: the numbers combined over all chunks, and whether the chunk is the first with that key.  A key
as common as can be is one entry per chunk.
"""

from __future__ import annotations

import gc
import struct
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import Scratch, texts
from corvane.llm.words import tidy

#: Bytes of text in a chunk, and in what one group of keys stands for, on average.
CHUNK_BYTES = 6 << 20
GROUP_BYTES = 8 << 20
#: Groups that a chunk deals its keys to at once, at most; beyond it keys go by way of batches of chunks.
FAN = 1 << 10

CHUNK = "chunk long, n_docs long, n_bytes long, body binary"
ASKED = "grp long, chunk long, body binary"
REPLY = "chunk long, pass int, grp long, body binary, n_keys long, total double"


# Arrays as bytes.


def _forms(a: np.ndarray) -> list[np.ndarray]:
    """The array in few bytes: bits for booleans, one to four bytes for numbers with the few larger ones apart, or only what isn't zero."""
    if a.dtype.kind == "b":
        return [np.array([1, len(a)]), np.packbits(a)]
    if a.dtype.kind == "f":
        some = a != 0
        if len(a) and 8 * some.sum() * a.itemsize < 7 * len(a) * a.itemsize:
            return [np.array([2, len(a)]), np.packbits(some), a[some]]
        return [np.array([0]), a]
    if len(a) and a.min() >= 0:
        over = np.flatnonzero(a >= 1 << 24)
        if a.itemsize > 4 and np.count_nonzero(a >= 1 << 16) * 4 > len(a) and len(over) * 12 < len(a):
            return [np.array([4]), (a & 0xFFFF).astype(np.uint16), (np.minimum(a, (1 << 24) - 1) >> 16).astype(np.uint8), over.astype(np.uint32), a[over]]
        best = None
        for kind in (np.uint8, np.uint16, np.uint32):
            if a.itemsize <= kind().itemsize:
                break
            over = np.flatnonzero(a >= np.iinfo(kind).max)
            cost = len(a) * kind().itemsize + len(over) * (4 + a.itemsize)
            if cost < len(a) * a.itemsize and (best is None or cost < best[0]):
                best = (cost, kind, over)
        if best is not None:
            return [np.array([3]), np.minimum(a, np.iinfo(best[1]).max).astype(best[1]), best[2].astype(np.uint32), a[best[2]]]
    return [np.array([0]), a]


def dump(arrays: Sequence[np.ndarray]) -> bytes:
    out = []
    for a in arrays:
        forms = _forms(a)
        out.append(struct.pack("<B", len(forms)))
        for x in forms:
            out += (struct.pack("<4sI", x.dtype.str[:4].encode(), x.nbytes), x.tobytes())
    return b"".join(out)


def load(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, forms = data[at], []
        at += 1
        for _ in range(n):
            kind, size = struct.unpack_from("<4sI", data, at)
            at += 8
            forms.append(np.frombuffer(data, kind.rstrip(b"\0").decode(), size // int(kind[2:].rstrip(b"\0")), at))
            at += size
        code = int(forms[0][0])
        if code == 0:
            a = forms[1]
        elif code == 1:
            a = np.unpackbits(forms[1], count=int(forms[0][1])).astype(bool)
        elif code == 2:
            a = np.zeros(int(forms[0][1]), forms[2].dtype)
            a[np.unpackbits(forms[1], count=len(a)).astype(bool)] = forms[2]
        elif code == 3:
            a = forms[1].astype(forms[3].dtype)
            a[forms[2]] = forms[3]
        else:
            a = forms[1].astype(forms[4].dtype) | forms[2].astype(forms[4].dtype) << 16
            a[forms[3]] = forms[4]
        out.append(a)
    return out


def _dump_keys(keys: np.ndarray, numbers: Sequence[np.ndarray]) -> bytes:
    return dump([keys[:1], np.diff(keys), *numbers])


def _load_keys(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    first, step, *numbers = load(data)
    out = np.empty(len(step) + 1, np.uint64)
    out[0] = first[0]
    np.cumsum(step, out=out[1:])
    out[1:] += first[0]
    return out, numbers


# Chunks.


class Chunk:
    """The documents of a chunk, by ascending id, then text."""

    def __init__(self, body: bytes):
        table = pa.ipc.open_stream(body).read_all()
        self.ids = table.column("doc_id").to_numpy()
        self.text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.large_string())


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def whole_texts(ids: pa.Array, text: pa.Array) -> bytes:
    """The body that ``Chunk`` reads."""
    return ipc(pa.table({"doc_id": ids, "text": text}))


def packer(body: Callable[[pa.Array, pa.Array], bytes], size: int):
    """Packs batches of (doc_id, text) into rows of CHUNK; ``body`` gets ids and texts, sorted by both."""

    def pack(batches):
        from pyspark import TaskContext

        held, n, seq, first = [], 0, 0, TaskContext.get().partitionId() << 24

        def emit():
            nonlocal held, n, seq
            t = pa.Table.from_batches(held)
            t = pa.table({"doc_id": t.column("doc_id"), "text": t.column("text").cast(pa.large_string())}).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
            out = pa.RecordBatch.from_arrays([pa.array([first | seq], pa.int64()), pa.array([t.num_rows], pa.int64()), pa.array([n], pa.int64()), pa.array([body(t.column("doc_id"), t.column("text"))], pa.binary())], ["chunk", "n_docs", "n_bytes", "body"])
            held, n, seq = [], 0, seq + 1
            return out

        for b in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy())
            lo = 0
            while lo < b.num_rows:
                before = int(lengths[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(lengths, before + size - n, "right")))
                held.append(b.slice(lo, hi - lo))
                n += int(lengths[min(hi, b.num_rows) - 1]) - before
                lo = hi
                if n >= size or lo < b.num_rows:
                    yield emit()
        if held:
            yield emit()

    return pack


class Replies:
    """Answers to the passes so far: ``replies[k]`` is (first, numbers...) in the keys' order of pass k."""

    def __init__(self, table: pa.Table | None):
        self.found: dict[int, list] = {}
        if table is None:
            return
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pass", "grp", "body"))), key=lambda r: r[:2])
        for k, _, body in rows:
            self.found.setdefault(k, []).append(body)

    def __getitem__(self, k: int) -> tuple[np.ndarray, ...] | None:
        parts = self.found.get(k)
        return None if parts is None else tuple(map(np.concatenate, zip(*map(load, parts))))


Ask = Callable[[object, Replies], tuple[np.ndarray, Sequence[np.ndarray]]]


def merged(bodies: list[bytes], ops: Sequence[str]):
    """(keys, combined numbers, group of every entry, which entries are first, entries of each body).

    ``ops`` says how numbers are combined: ``sum``, ``min``, ``max``, ``same`` (the number
    if all are equal, else -1) or ``least at max`` (the least where the number before is greatest).
    """
    parts = [_load_keys(x) for x in bodies]
    size = [len(p[0]) for p in parts]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)  # not stable: the first entry of a key is the least of its run
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(new)
    group = np.empty(len(order), np.int32)
    group[order] = np.cumsum(new) - 1
    first = np.zeros(len(order), bool)
    first[np.minimum.reduceat(order, at)] = True
    answers, before = [], None
    for k, op in enumerate(ops):
        v = np.concatenate([p[1][k] for p in parts])
        wide = (v.astype(np.float64) if v.dtype.kind == "f" else v.astype(np.int64))[order]
        r = {"sum": np.add, "max": np.maximum}.get(op, np.minimum).reduceat(wide, at)
        if op == "least at max":
            best = before == np.maximum.reduceat(before, at)[group[order]]
            r = np.minimum.reduceat(np.where(best, wide, np.iinfo(np.int64).max), at)
        before = wide
        answers.append(np.where(r == np.maximum.reduceat(wide, at), r, -1) if op == "same" else r)
    return keys[at], answers, group, first, size


class Exchange:
    """A corpus in chunks, and what has been asked about it so far.

    Spark knows bucketed tables by a name; ``with`` gives both names up at the end of the block.  The
    files belong to the scratch, and DataFrames made before go on reading them.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, body=whole_texts, read: Callable[[bytes], object] = Chunk, key: str = "doc_id", text: str = "text", size: int = CHUNK_BYTES, group: int = GROUP_BYTES, fan: int = FAN):
        self.spark, self.scratch, self.read, self.fan = docs.sparkSession, scratch, read, fan
        self.n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: dict[str, tuple[str, str]] = {}
        rows = texts(docs, key, text).where("doc_id is not null").mapInArrow(packer(body, size), CHUNK)
        self.chunks = self._append("chunks", rows)
        self.replies: DataFrame | None = None
        self.n_bytes = self.chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        self.group, self.groups = group, max(self.n, -(-self.n_bytes // group))

    def __enter__(self) -> Exchange:
        return self

    def __exit__(self, *_) -> None:
        for name, _ in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _append(self, what: str, rows: DataFrame) -> DataFrame:
        if what not in self.names:
            self.names[what] = f"corvane_{uuid.uuid4().hex}", self.scratch.path(what)
        name, path = self.names[what]
        if what == "replies":  # a file for each bucket, where it would be one for each task and bucket
            rows = rows.repartition(self.n, "chunk")
        rows.write.format("parquet").mode("append").option("compression", "zstd" if what == "replies" else "none").option("parquet.enable.dictionary", "false").option("path", path).bucketBy(self.n, "chunk").saveAsTable(name)
        gc.collect()  # lets Spark remove the shuffle files of this pass now
        self.spark._jvm.System.gc()
        return self.spark.table(name)

    def _each(self, f: Callable[[int, object, Replies], pa.Table], schema: str, passes: Sequence[int] | None = None) -> DataFrame:
        """f (chunk's number, chunk, replies to it) of every chunk."""
        read = self.read
        if self.replies is None:

            def alone(batches):
                for b in batches:
                    for c, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                        tidy()
                        yield from f(c, read(body.as_py()), Replies(None)).to_batches()

            return self.chunks.select("chunk", "body").mapInArrow(alone, schema)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            tidy()
            return f(left.column("chunk")[0].as_py(), read(left.column("body")[0].as_py()), Replies(right))

        known = self.replies if passes is None else self.replies.where(F.col("pass").isin(list(passes)))
        # A chunk without words has no replies, and a reply always has its chunk.
        return self.chunks.select("chunk", "body").groupBy("chunk").cogroup(known.select("chunk", "pass", "grp", "body").groupBy("chunk")).applyInArrow(both, schema)

    def visit(self, f: Callable[[object, Replies], pa.Table], schema: str) -> DataFrame:
        """Applies f to every chunk and the replies to it."""
        return self._each(lambda _, chunk, replies: f(chunk, replies), schema)

    def ask(self, number: int, keys_of: Ask, ops: Sequence[str], bits: int = 64, finish=None, passes: Sequence[int] | None = None) -> tuple[int, float]:
        """One pass: asks about every chunk's keys and stores the replies of pass ``number``.

        ``keys_of`` gives a chunk's keys, sorted and distinct, and arrays of numbers with one entry per
        key; ``ops`` says how the numbers of chunks are combined (see ``merged``), and ``finish``, if
        any, makes the answers of the combined numbers.  Keys are below 2 ** ``bits``; fewer bits take
        less to send.  Returns the distinct keys with a positive first number, and the sum of those.
        """
        coarse = 1 if self.groups <= self.fan else int(np.ceil(np.sqrt(self.groups)))
        fine = -(-self.groups // coarse)
        batches = 1 if coarse == 1 else int(-(-self.n_bytes // (coarse * self.group)))
        edges = lambda parts, lo=0, hi=1 << bits: np.array([lo + (hi - lo) * i // parts for i in range(1, parts)], np.uint64)
        direct = coarse == 1

        def deal(keys, numbers, bounds, name, chunk):
            cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            some = [(g, a, b) for g, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            body = [_dump_keys(keys[a:b], [x[a:b] for x in numbers]) for _, a, b in some]
            return pa.table({"grp": pa.array([name(g) for g, *_ in some], pa.int64()), "chunk": pa.array([chunk] * len(some), pa.int64()), "body": pa.array(body, pa.binary())})

        def emit(number_of_chunk, chunk, old):
            keys, numbers = keys_of(chunk, old)
            batch = number_of_chunk * 0x9E3779B97F4A7C15 % (1 << 64) % batches
            return deal(keys, numbers, edges(fine if direct else coarse), (lambda g: g) if direct else (lambda g: g * batches + batch), number_of_chunk)

        def answer(bodies, chunks, answers, group, first, size, grp, n_keys, total):
            out, a = [], 0
            for n in size:
                mine = group[a : a + n]
                out.append(dump([first[a : a + n], *(r[mine] for r in answers)]))
                a += n
            rest = [0] * (len(bodies) - 1)
            return pa.table({"chunk": chunks, "pass": pa.array([number] * len(bodies), pa.int32()), "grp": pa.array([grp] * len(bodies), pa.int64()), "body": pa.array(out, pa.binary()), "n_keys": pa.array([n_keys, *rest], pa.int64()), "total": pa.array([total, *map(float, rest)], pa.float64())})

        def combine(t: pa.Table) -> pa.Table:
            tidy()
            t = t.sort_by("chunk")
            bodies = [x.as_py() for x in t.column("body")]
            _, answers, group, first, size = merged(bodies, ops)
            n_keys, total = int((answers[0] > 0).sum()), float(answers[0].sum())
            return answer(bodies, t.column("chunk"), finish(answers) if finish else answers, group, first, size, t.column("grp")[0].as_py(), n_keys, total)

        def merge(t: pa.Table) -> pa.Table:
            t = t.sort_by("chunk")
            name = t.column("grp")[0].as_py()
            keys, answers, *_ = merged([x.as_py() for x in t.column("body")], ops)
            lo, hi = ((1 << bits) * (name // batches + i) // coarse for i in (0, 1))
            return deal(keys, answers, edges(fine, lo, hi), lambda g: name // batches * fine + g, name)

        def back(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("chunk")
            bodies = [x.as_py() for x in left.column("body")]
            _, _, group, own, size = merged(bodies, [])
            first, *answers = Replies(right)[number]
            return answer(bodies, left.column("chunk"), answers, group, own & first[group], size, left.column("grp")[0].as_py() // batches, sum(right.column("n_keys").to_pylist()), sum(right.column("total").to_pylist()))

        asked = self._each(emit, ASKED, passes)
        if direct:
            replies = asked.groupBy("grp").applyInArrow(combine, REPLY)
        else:
            asked = self.scratch.store(asked, "asked")
            met = asked.groupBy("grp").applyInArrow(merge, ASKED).groupBy("grp").applyInArrow(combine, REPLY)
            replies = asked.groupBy("grp").cogroup(met.withColumnRenamed("grp", "fine").withColumnRenamed("chunk", "grp").select("grp", "pass", F.col("fine").alias("grp_"), "body", "n_keys", "total").groupBy("grp")).applyInArrow(lambda a, b: back(a, b.rename_columns(["chunk", "pass", "grp", "body", "n_keys", "total"])), REPLY)
        self.replies = self._append("replies", replies)
        mine = self.replies.where(F.col("pass") == number)
        return tuple(mine.agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0.0))).first())
