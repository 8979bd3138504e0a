"""Words of a whole Arrow batch at once.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; as UTF-8 never uses those bytes inside a character, bytes and characters agree.
Everything here works on one flat byte buffer with document offsets, so the cost per document is
that of its bytes and not of a Python loop.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words (fixed values of the contract).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the polynomial hashes.
BASE = 0x9E3779B97F4A7C15
GRAM = (0xD6E8FEB86659FD93, 0xA3B195354A39B70D)
_MASK = (1 << 64) - 1
#: Bytes hashed per pass, so that the working arrays stay in cache.
SLICE = 1 << 18


def tidy() -> None:
    """Gives back what the arrays of the part, chunk or group before have left in this worker, which lives on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run):
    """The function of batches, after whose end the worker, which lives on, gives back what it held."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def parts(batch: pa.RecordBatch, column: str = "text", size: int = 2 << 20):
    """The batch in slices of at most ``size`` bytes of text, or one longer text alone.

    The arrays made for words take many times the text's bytes.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        tidy()
        a = b


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word, in text order."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SEP.take(buf)
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of splitmix64: spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + SLICE, "right")))
        size = int(end[j - 1] - lo)
        power, inverse = _power(max(size + 1, SLICE))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((buf[lo : lo + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
        a = start[i:j] - lo
        out[i:j] = (sums[end[i:j] - lo] - sums[a]) * inverse[a]
        i = j
    return mix(out + (end - start).astype(np.uint64))


def grams(hashes: np.ndarray, k: int, family: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each k consecutive words, from every position or from those in ``at``."""
    if at is None:
        n = max(0, len(hashes) - k + 1)
        take = lambda j: hashes[j : j + n]
    else:
        n = len(at)
        take = lambda j: hashes[at + j]
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= np.uint64(GRAM[family])
            out += take(j)
    return mix(out)


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each position belong to one document."""
    n = max(0, len(doc) - k + 1)
    return doc[:n] == doc[k - 1 : k - 1 + n] if n else np.zeros(0, bool)


def first_of(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Number of words before each document's first (n_docs + 1 entries)."""
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, a position of each, index of every key's); faster than np.unique, as no order of positions is kept."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    index = np.empty(len(keys), np.int64)
    index[order] = np.cumsum(new) - 1
    return sorted_[new], order[new], index
