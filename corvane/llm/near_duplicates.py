"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put in bands by size, so that any two sets alike enough lie in the same
band or in neighbouring ones.  For two neighbouring bands the domain of shingles is partitioned by
hash in two levels.  Sets that may be linked differ in at most K elements; so, of the first-level
partitions, some have at most k2 of the differences, and there all but k2 of the second-level ones
are equal.  A signature is a first-level partition with a subset of its second-level ones: all
subsets of n2 - k2 are enumerated, and linked sets share one of them.

Documents with a signature in common are candidates.  Equal sets have one representative.  The others
are compared, element by element, to the most central document of each of their signatures, its leader;
then documents that have one leader but aren't in one component are compared too, so no link is lost.
Pairs that a parity sketch, as long as the sets, proves unlike are left out of that.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import words as W
from corvane.llm.components import components
from corvane.llm.exchange import Chunk, Exchange, Replies
from corvane.llm.frames import Scratch

SHINGLE = 5
#: Similarity of a link as a fraction.
ALIKE = (3, 4)
#: Bytes of text in a chunk: a set has more signatures than elements, and the arrays for them must fit.
CHUNK_BYTES = 4 << 20
#: 64-bit words of the brief sketch that pairs are first judged by.
BRIEF = 16
#: Pairs that one copy of a document's set is compared in, on average; beyond it there are more copies.
PER_COPY = 256
#: Documents of one leader that meet those of another block, or each other, in one group, on average.
BLOCK = 512


def shingle_sets(chunk: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), distinct and sorted by both; shorter texts have their whole sequence."""
    buf, offs = W.utf8(chunk.text)
    buf = W.lower_ascii(buf)
    start, end, doc = W.spans(buf, offs)
    h = W.span_hashes(buf, start, end)
    at = np.flatnonzero(W.inside(doc, k))
    docs, grams = [doc[at]], [W.grams(h, k, at=at)]
    first = W.first_of(doc, len(chunk.ids))
    size = np.diff(first)
    for n in range(1, k):
        few = np.flatnonzero(size == n)
        docs.append(few)
        grams.append(W.grams(h, n, at=first[few]))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    # By document, then by the hash's upper bits, which tell the shingles of one document apart.
    room = np.uint64(max(1, len(chunk.ids).bit_length()))
    order = np.argsort(doc.astype(np.uint64) << (np.uint64(64) - room) | gram >> room)
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[new], gram[new]


def bands(largest: int, alike=ALIKE) -> np.ndarray:
    """Upper sizes of the bands: a set's partners lie in its own band or the next ones to it."""
    num, den = alike
    out = [0]
    while out[-1] < largest:
        out.append((out[-1] + 1) * den // num)
    return np.array([*out, (out[-1] + 1) * den // num])


def furthest(m: int, larger: int, alike=ALIKE) -> int:
    """Most elements in which sets of these sizes can differ and still be linked."""
    num, den = alike
    return (m + larger) * (den - num) // (den + num)


#: Elements that a signature covers at least, on average, where sets are large enough.
COVERED = 2.8
#: Share of sets that may need another partitioning, and how many partitionings there are.
WEAK, SEEDS = 0.1, 3


@cache
def scheme(name: int, alike=ALIKE) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for the sets that meet under this name: those of band ``name`` and of the one below.

    Of n1 first-level partitions, spare + 1 at least have at most k2 differences.  A partition of a set
    is unsafe if so many of its n2 parts are empty that a signature has no element.  A set with at most
    ``spare`` unsafe ones shares a signature with elements.  Two sets of which neither is so, which are
    few, meet in another partitioning, and at last in signatures without elements.  The fewest
    signatures win among the schemes whose signatures cover enough elements.
    """
    upper = bands_to(name, alike)
    small, large = (upper[name - 1] if name else 0), upper[name]
    least = (upper[name - 2] if name > 1 else 0) * 9 // 10 + small // 10 + 1
    most = furthest(small, large, alike)
    if not most:
        return 1, 1, 0, 0
    options = []
    for k2 in range(min(most, 4) + 1):
        for n2 in range(k2 + 1, k2 + 7):
            base = most // (k2 + 1) + 1
            n1, spare, u = base, 0, 0.0
            for _ in range(4 if base > 1 else 1):  # more partitions have fewer elements each
                mean, u = least / n1, 0.0
                for j in range(40 + int(3 * mean)):
                    crowded = 1.0 if j <= k2 else min(1.0, math.comb(n2, k2) * (k2 / n2) ** j)
                    u += crowded * (math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) if base > 1 else float(j == least))
                spare = max(0, math.ceil(n1 * u + 1.3 * math.sqrt(n1 * u) - 0.5)) if base > 1 else 0
                n1 = base + spare
            options.append((n1 * math.comb(n2, k2), -small * (n2 - k2) / (n1 * n2), u if n1 == 1 else WEAK, (n1, n2, k2, spare)))
    good = [o for o in options if -o[1] >= min(COVERED, 2 + 0.04 * small, 0.55 * small) and o[2] <= WEAK]
    return min(good)[3] if good else min(options, key=lambda o: o[1])[3]


def bands_to(name: int, alike=ALIKE) -> list[int]:
    num, den = alike
    out = [0]
    while len(out) <= name:
        out.append((out[-1] + 1) * den // num)
    return out


class _Signed:
    """Signatures of a chunk's distinct sets."""

    def __init__(self, chunk: Chunk, bits: int, alike=ALIKE):
        self.doc, self.gram = shingle_sets(chunk)
        n = len(chunk.ids)
        self.m = np.bincount(self.doc, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.m)])
        one, two = W.mix(self.gram), W.mix(self.gram ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        some = np.flatnonzero(self.m)
        prints = np.zeros((2, n), np.uint64)
        if len(some):
            for k, x in enumerate((one, two)):
                prints[k, some] = np.add.reduceat(x, self.start[some])
        # Documents with equal sets have one representative, that with the least id.
        seen: dict = {}
        self.rep = np.array([seen.setdefault((a, b, c) if c else -k, k) for k, (a, b, c) in enumerate(zip(*prints.tolist(), self.m.tolist()))], np.int64)
        live = np.zeros(n, bool)
        live[np.unique(self.rep[some])] = True
        self.live = np.flatnonzero(live)
        # The name of a whole set among the signatures: equal sets of other chunks meet under it.
        equal = W.mix(prints[0] ^ W.mix(prints[1] ^ self.m.astype(np.uint64))) >> np.uint64(64 - bits)
        self.band = np.searchsorted(bands(int(self.m.max(initial=0)), alike), self.m)
        owner, sig, steps = [self.live], [equal[self.live]], [np.full(len(self.live), 2, np.int8)]
        for step in (0, 1):
            for name in np.unique(self.band[self.live] + step).tolist():
                mine = self.live[self.band[self.live] == name - step]
                o, s = self._signatures(mine, name, one, two, alike)
                owner.append(o)
                sig.append(s >> np.uint64(64 - bits))
                steps.append(np.full(len(o), step, np.int8))
        self.owner, self.sig, self.step = np.concatenate(owner), np.concatenate(sig), np.concatenate(steps)
        self.keys, _, self.index = W.distinct(self.sig)

    def _signatures(self, mine, name, one, two, alike, seed=0):
        n1, n2, k2, spare = scheme(name, alike)
        size = self.m[mine]
        at = np.repeat(self.start[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        d = np.repeat(np.arange(len(mine)), size)
        x = W.mix(one[at] + np.uint64(seed)) if seed else one[at]
        part = (d * n1 + ((x >> np.uint64(32)) * np.uint64(n1) >> np.uint64(32)).astype(np.int64)) * n2 + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(n2) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(len(mine) * n1 * n2, np.uint64)
        np.add.at(sums, part, two[at])
        full = (np.bincount(part, minlength=len(sums)) > 0).reshape(len(mine), n1, n2)
        sums = W.mix(sums + np.tile(np.arange(n2, dtype=np.uint64) + np.uint64(1), len(mine) * n1)).reshape(len(mine), n1, n2)
        weak = (full.sum(2) <= k2).sum(1) > spare
        last = seed == SEEDS - 1
        first = np.uint64(seed) << np.uint64(56) | np.uint64(name) << np.uint64(40) | np.arange(n1, dtype=np.uint64) << np.uint64(8)
        out_o, out_s = [], []
        for c, parts in enumerate(combinations(range(n2), n2 - k2)):
            total = sums[:, :, parts].sum(2, dtype=np.uint64)
            use = full[:, :, parts].any(2)
            if last:
                use |= weak[:, None]
            s = W.mix(total ^ W.mix(first | np.uint64(c))[None])
            who, _ = np.nonzero(use)
            out_o.append(mine[who])
            out_s.append(s[use])
        if weak.any() and not last:
            o, s = self._signatures(mine[weak], name, one, two, alike, seed + 1)
            out_o.append(o)
            out_s.append(s)
        return np.concatenate(out_o), np.concatenate(out_s)

    def sketches(self, docs: np.ndarray, step: int) -> pa.Array:
        """Parities of the elements of these documents' sets in buckets, one to two times as many as the largest set of the name has.

        Where two sketches differ, the sets do at least as often.
        """
        tops = np.array(bands_to(int(self.band.max(initial=0)) + step))[self.band[docs] + step]
        n_bits = np.maximum(64 * BRIEF, 1 << np.ceil(np.log2(1.1 * tops)).astype(np.int64))
        base = np.concatenate([[0], np.cumsum(n_bits)])
        size = self.m[docs]
        at = np.repeat(self.start[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        bit = (W.mix(self.gram[at] ^ np.uint64(0xC3C3C3C3C3C3C3C3)) & np.repeat(n_bits.astype(np.uint64) - np.uint64(1), size)).astype(np.int64)
        parity = np.bincount(bit + np.repeat(base[:-1], size), minlength=base[-1]).astype(np.uint8) & 1
        return pa.ListArray.from_arrays(pa.array(base // 64, pa.int32()), pa.array(np.packbits(parity).view(np.int64)))


def _used(chunk: Chunk, replies: Replies, bits: int):
    """(sets, positions of the signatures that other sets have too, their keys, index of each one's key, how central each document is).

    A document is the more central the more documents share its signatures; among edited copies of one
    text that is the text itself, to which all copies are linked, though not to each other.
    """
    s = _Signed(chunk, bits)
    got = replies[0]
    count = got[1].astype(np.int64)[s.index] if got is not None else np.zeros(0, np.int64)
    use = np.flatnonzero(count >= 2)
    keys, _, index = W.distinct(s.sig[use])
    central = np.bincount(s.owner[use], weights=count[use], minlength=len(chunk.ids)).astype(np.int64)
    return s, use, keys, index, central


NODES = "doc_id long, rep long, n_shingles long, shingles binary, entries array<struct<leader:long,name:int,n:long>>, band int, sketch_0 array<long>, sketch_1 array<long>"


def _passes(bits: int):
    def pass0(chunk: Chunk, _: Replies):
        s = _Signed(chunk, bits)
        return s.keys, (np.bincount(s.index, minlength=len(s.keys)),)

    def pass1(chunk: Chunk, replies: Replies):
        s, use, keys, index, central = _used(chunk, replies, bits)
        owner = s.owner[use]
        order = np.lexsort((chunk.ids[owner], -central[owner], index))
        lead = owner[order[np.searchsorted(index[order], np.arange(len(keys)))]]
        return keys, (central[lead], chunk.ids[lead], np.bincount(index, minlength=len(keys)))

    def nodes(chunk: Chunk, replies: Replies) -> pa.Table:
        """A row per document; representatives with a candidate carry their set, the leaders of its signatures, and sketches."""
        s, use, _, index, _ = _used(chunk, replies, bits)
        got, n = replies[1], len(chunk.ids)
        step, owner = s.step[use], s.owner[use]
        lead, many = (got[1][index], got[2].astype(np.int64)[index]) if got is not None else (owner[:0], owner[:0])
        equal = chunk.ids.copy()
        equal[owner[step == 2]] = lead[step == 2]  # a set that another chunk has too, under a lesser id, is looked at there
        mine = np.flatnonzero((step < 2) & (equal[owner] == chunk.ids[owner]))
        mine = mine[np.lexsort((lead[mine], step[mine], owner[mine]))]
        owner, step, lead, many = owner[mine], step[mine], lead[mine], many[mine]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1]) | (lead[1:] != lead[:-1])
        at = np.flatnonzero(new)
        entries = pa.StructArray.from_arrays([pa.array(lead[at], pa.int64()), pa.array((s.band[owner] + step)[at], pa.int32()), pa.array(np.maximum.reduceat(many, at) if len(at) else many, pa.int64())], ["leader", "name", "n"])
        edge = np.searchsorted(owner[at], np.arange(n + 1))
        some = np.flatnonzero(np.diff(edge))
        whole = np.zeros(n, bool)
        whole[some] = True
        data = s.gram[whole[s.doc]]
        offsets = np.concatenate([[0], np.cumsum(np.where(whole, s.m, 0))]) * 8
        place = np.full(n, -1)
        place[some] = np.arange(len(some))
        sketch = [s.sketches(some, k).take(pa.array(place, pa.int64(), mask=place < 0)) for k in (0, 1)] if len(some) else [pa.nulls(n, pa.list_(pa.int64()))] * 2
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64()), "rep": pa.array(equal[s.rep] if n else chunk.ids, pa.int64()), "n_shingles": pa.array(s.m, pa.int64()),
            "shingles": pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()),
            "entries": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), entries), "band": pa.array(s.band, pa.int32()), "sketch_0": sketch[0], "sketch_1": sketch[1],
        })

    return pass0, pass1, nodes


def _alike(pairs: DataFrame, alike=ALIKE) -> DataFrame:
    """The (a, b) of rows (a, b, s_a, s_b) whose sets are alike enough, compared element by element."""
    num, den = alike

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("s_a"), b.column("s_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "s_a", "s_b").mapInArrow(W.tidied(compare), "a long, b long")


def _copies(n):
    """How many copies of a leader ``n`` documents of its signatures need."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(PER_COPY))).cast("int")


def _entries(some: DataFrame) -> DataFrame:
    """A row per document b and leader a of its signatures of one name: (a, b, name, n_b, copy, sk_b)."""
    e = some.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), "band", "sketch_0", "sketch_1", F.explode("entries").alias("e"))
    sketch = F.when(F.col("e.name") == F.col("band"), F.col("sketch_0")).otherwise(F.col("sketch_1"))
    return e.select(F.col("e.leader").alias("a"), "b", F.col("e.name").alias("name"), "n_b", F.pmod(F.xxhash64("b"), _copies(F.col("e.n"))).cast("int").alias("copy"), sketch.alias("sk_b"))


def _leaders(some: DataFrame, *columns: str) -> DataFrame:
    """(a, copy, ...): the documents that lead signatures, in as many copies as those need at PER_COPY for each."""
    own = F.array_max(F.transform(F.filter("entries", lambda e: e["leader"] == F.col("doc_id")), lambda e: e["n"]))
    return some.where(own.isNotNull()).select(F.col("doc_id").alias("a"), *columns, F.explode(F.sequence(F.lit(0), _copies(own) - 1)).alias("copy"))


def _near_leaders(some: DataFrame) -> DataFrame:
    """(a, b, copy): documents and leaders that their sketches don't prove unlike."""
    leaders = _leaders(some, "n_shingles", "band", "sketch_0", "sketch_1").select("a", "copy", F.col("n_shingles").alias("n_a"), F.posexplode(F.array("sketch_0", "sketch_1")).alias("step", "sk_a"), "band").withColumn("name", F.col("band") + F.col("step"))
    met = _entries(some).where("a <> b").join(leaders.drop("band", "step"), ["a", "name", "copy"]).where(_may_link())
    return met.groupBy("a", "b").agg(F.min("copy").alias("copy"))


def _led(near: DataFrame, some: DataFrame) -> DataFrame:
    """(a, b, s_a, s_b) of stored pairs of a leader and a document, which has few."""
    return near.join(some.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b").join(_leaders(some, "shingles").withColumnRenamed("shingles", "s_a"), ["a", "copy"])


def _with_sets(pairs: DataFrame, some: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, s_a, s_b) of stored pairs; a document in very many of them is dealt to several tasks."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.ceil(F.count("*") / F.lit(PER_COPY)).cast("int").alias("copies"))
    ends = scratch.store(ends, "ends")
    sets = scratch.store(some.select("doc_id", "shingles").join(ends, "doc_id"), "sets")
    for c, other in (("a", "b"), ("b", "a")):
        of = ends.select(F.col("doc_id").alias(c), F.col("copies").alias(f"copies_{c}"))
        pairs = pairs.join(of, c).withColumn(f"copy_{c}", F.pmod(F.xxhash64(other), f"copies_{c}").cast("int")).drop(f"copies_{c}")
    for c in ("a", "b"):
        own = sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(f"copy_{c}"))
        pairs = pairs.join(own, [c, f"copy_{c}"])
    return pairs


def _brief(sketch: str, c: str) -> list:
    """The columns ``c``0, ``c``1, ... of a sketch folded to BRIEF words, a shorter one filled up with zeros."""
    fold = lambda k: F.aggregate(F.filter(sketch, lambda x, i: i % BRIEF == k), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    return [fold(k).alias(f"{c}{k}") for k in range(BRIEF)]


def _may_link(a: str = "n_a sk_a", b: str = "n_b sk_b", brief: tuple[str, str] | None = None, alike=ALIKE):
    """Whether two sets under one signature can be linked, by sizes and sketches; false only if they certainly aren't.

    ``brief`` names the columns of brief sketches, which are judged first and much the faster; where
    they say all, the whole sketches are null.
    """
    num, den = alike
    (n_a, sk_a), (n_b, sk_b) = (map(F.col, x.split()) for x in (a, b))
    few = lambda differ: differ * (den + num) <= (n_a + n_b) * (den - num)
    differ = F.aggregate(F.zip_with(sk_a, sk_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = (n_a * den >= n_b * num) & (n_b * den >= n_a * num)
    if brief is None:
        return sizes & few(differ)
    first = sum((F.bit_count(F.col(f"{brief[0]}{k}").bitwiseXOR(F.col(f"{brief[1]}{k}"))) for k in range(BRIEF)), F.lit(0))
    return sizes & few(first) & F.coalesce(few(differ), F.lit(True))


def _members(some: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, name, b, label): documents with a signature of leader a that two others have too, and their components.

    Of two documents with a signature one is the leader, to which all the others are compared already.
    """
    e = some.select(F.col("doc_id").alias("b"), F.explode("entries").alias("e")).where((F.col("e.leader") != F.col("b")) & (F.col("e.n") > 2))
    e = e.select(F.col("e.leader").alias("a"), F.col("e.name").alias("name"), "b")
    return e.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", "name", "b", F.coalesce("label", "b").alias("label"))


def _closing(members: DataFrame, some: DataFrame) -> DataFrame:
    """(a, b), a < b: documents of one leader in different components that their sketches don't prove unlike.

    Every pair with a signature in common is among those of its leader.  A pair comes up once for each
    leader, however many signatures it shares.  A leader's documents are split by hash into blocks of
    bounded size, and every two blocks meet under a key of their own.
    """
    blocks = members.groupBy("a", "name").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("a", "name", "blocks")
    known = some.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n"), F.posexplode(F.array("sketch_0", "sketch_1")).alias("step", "sk"), "band").withColumn("name", F.col("band") + F.col("step"))
    known = known.select("b", "name", "n", F.when(F.size("sk") > BRIEF, F.col("sk")).alias("sk"), *_brief("sk", "q"))
    left = members.join(blocks, ["a", "name"]).join(known, ["b", "name"]).withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    left = left.select("a", "name", "low", "high", "block", F.col("b").alias("node"), "label", "n", "sk", *(f"q{k}" for k in range(BRIEF)))
    # The same rows on both sides, so that they are shuffled once.
    x, y = left.alias("x"), left.alias("y")
    met = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("a", "name", "low", "high")]
    pairs = x.join(y, reduce(and_, met) & (F.col("x.label") < F.col("y.label")) & ((F.col("x.low") == F.col("x.high")) | (F.col("x.block") != F.col("y.block"))) & _may_link("x.n x.sk", "y.n y.sk", ("x.q", "y.q")))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", **exchange) -> DataFrame:
    """(doc_id, n_shingles, component_id): the near-duplicate component of every document.

    A null or empty text, or one without words, has no shingles and stands alone.  Rows without an id
    are left out; rows that repeat an id are one node, and each gives a row.  A text longer than a
    chunk is a chunk of its own, and is compared whole.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        with Scratch(spark) as own, Exchange(docs, own, key=key, text=text, **{"size": CHUNK_BYTES} | exchange) as ex:
            # So many bits that signatures of different sets seldom have one name; it would cost a comparison.
            bits = min(64, max(42, int(ex.n_bytes).bit_length() + 12))
            pass0, pass1, visit = _passes(bits)
            ex.ask(0, pass0, ["sum"], bits, finish=lambda x: [np.minimum(x[0], 255)])
            ex.ask(1, pass1, ["max", "least at max", "sum"], bits, finish=lambda x: x[1:])
            nodes = scratch.store(ex.visit(visit, NODES), "nodes")
        some = nodes.where(F.size("entries") > 0)
        near = scratch.store(_near_leaders(some), "near")
        links = scratch.store(_alike(_led(near, some)).unionByName(nodes.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), "links")
        labels = components(links, scratch)
        # Documents under one leader that aren't in one component: those pairs remain.
        members = scratch.store(_members(some, labels), "members")
        pairs = _closing(members, some).join(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        more = scratch.store(_alike(_with_sets(scratch.store(pairs, "left"), some, scratch)), "links")
        if more.limit(1).count():
            labels = components(links.unionByName(more), scratch)
        found = nodes.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
        return Scratch(spark).store(found, "components")
