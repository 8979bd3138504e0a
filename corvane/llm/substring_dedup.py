"""Substring dedup by fixed-block anchors.

A window of w words contains a whole block of b = w // 2 words wherever blocks of b words lie end to
end from a document's start.  So if a window occurs twice, the earlier document's block inside it
equals the b words at the same place of the later window.  Pass 0 indexes the blocks of every
document and probes them with every rolling run of b words.  A hit is an anchor; it is extended, word
by word, over the runs that occur twice themselves, to all windows that may be exact repeats.  Pass 1
finds where each of those windows occurs first.  Every word of a window that isn't the first of its
kind goes; windows one after the other make up maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm import words as W
from corvane.llm.exchange import Chunk, Exchange, Replies
from corvane.llm.frames import Scratch

#: Bytes of text in a chunk, which a task's arrays take many times.
CHUNK_BYTES = 4 << 20
WINDOW = 20
#: Bits of an anchor's hash; a false anchor costs a comparison, not a wrong result.
ANCHOR_BITS = 46


class _Words:
    def __init__(self, chunk: Chunk):
        self.buf, self.offs = W.utf8(chunk.text)
        self.start, self.end, self.doc = W.spans(self.buf, self.offs)
        self.hash = W.span_hashes(self.buf, self.start, self.end)
        self.first = W.first_of(self.doc, len(chunk.ids))


def _anchors(words: _Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, starts a block) of every run of words that an anchor may be."""
    block = window // 2
    at = np.flatnonzero(W.inside(words.doc, block))
    at = at[(np.diff(words.first) >= window)[words.doc[at]]]
    key = W.grams(words.hash, block, at=at) >> np.uint64(64 - ANCHOR_BITS)
    return at, key, (at - words.first[words.doc[at]]) % block == 0


def _pass0(window: int):
    def keys_of(chunk: Chunk, _: Replies):
        _, key, block = _anchors(_Words(chunk), window)
        both = np.sort(key << np.uint64(1) | block.astype(np.uint64))
        key = both >> np.uint64(1)
        edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([edge, [len(key)]]))
        is_block = (both[edge + count - 1] & np.uint64(1)).astype(np.uint8) if len(edge) else np.zeros(0, np.uint8)
        return key[edge], (np.minimum(count, 2).astype(np.uint8), is_block)

    return keys_of


def _windows(chunk: Chunk, replies: Replies, window: int):
    """(words, window starts, index of each one's key, keys, first window of each key): all that may occur twice."""
    words, none = _Words(chunk), np.zeros(0, np.int64)
    found = replies[0]
    if found is None:
        return words, none, none, np.zeros(0, np.uint64), none
    at, key, _ = _anchors(words, window)
    _, _, index = W.distinct(key)
    n = len(words.hash)
    twice, anchored = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    twice[1:][at] = (found[1] >= 2)[index]
    anchored[1:][at] = (found[2] > 0)[index]
    twice, anchored = np.cumsum(twice), np.cumsum(anchored)
    runs = window - window // 2 + 1
    inner = np.flatnonzero(W.inside(words.doc, window))
    cand = inner[(twice[inner + runs] - twice[inner] == runs) & (anchored[inner + runs] > anchored[inner])]
    keys, some, index = W.distinct(W.grams(words.hash, window, at=cand))
    first = np.full(len(keys), n)
    np.minimum.at(first, index, cand)
    return words, cand, index, keys, first


def _pass1(window: int):
    def keys_of(chunk: Chunk, replies: Replies):
        words, _, _, keys, first = _windows(chunk, replies, window)
        check = (W.grams(words.hash, window, 1, at=first) >> np.uint64(32)).astype(np.uint32)
        return keys, (chunk.ids[words.doc[first]], check)

    return keys_of


def _removed(chunk: Chunk, replies: Replies, window: int) -> tuple[_Words, np.ndarray]:
    words, cand, index, _, first = _windows(chunk, replies, window)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    found = replies[1]
    if found is not None and len(cand):
        _, owner, check = found
        later = (chunk.ids[words.doc[cand]] > owner[index]) | (cand != first[index])
        gone = cand[later & (check >= 0)[index]]
        np.add.at(cover, gone, 1)
        np.subtract.at(cover, gone + window, 1)
    return words, np.cumsum(cover[:-1]) > 0


RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,stop:long>>"


def dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, **exchange) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): every document without its repeated passages.

    ``kept`` has the words left, joined by one space; ``removed`` the runs of words that went, as word
    positions.  A null or empty text has no words, and texts shorter than a window lose none.  Rows
    without an id are left out.  Rows that repeat an id count as one document for what is earlier, and
    each gives a row.  A text longer than a chunk is a chunk of its own.  The result reads what is in
    ``scratch``, which the caller may drop once the result is written.
    """

    def final(chunk: Chunk, replies: Replies) -> pa.Table:
        words, gone = _removed(chunk, replies, window)
        n = len(chunk.ids)
        stay = ~gone
        mark = np.zeros(len(words.buf) + 2, np.int8)
        last = np.zeros(len(gone), bool)
        kept_at = np.flatnonzero(stay)
        last_of = kept_at[np.flatnonzero(np.diff(words.doc[kept_at], append=-1))] if len(kept_at) else kept_at
        last[last_of] = True
        stop = words.end + ~last
        mark[words.start[kept_at]] = 1
        mark[stop[kept_at]] -= 1
        mask = np.cumsum(mark[:-2], dtype=np.int8).astype(bool)
        out = words.buf.copy()
        out[W._SEP.take(out)] = 32
        size = np.concatenate([[0], np.cumsum(mask)])[words.offs]
        kept = pa.LargeStringArray.from_buffers(n, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out[mask]))
        edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (words.doc[1:] != words.doc[:-1])])) if len(gone) else kept_at
        close = np.flatnonzero(gone & np.concatenate([~gone[1:] | (words.doc[1:] != words.doc[:-1]), [True]])) + 1 if len(gone) else kept_at
        base = words.first[words.doc[edge]] if len(edge) else edge
        runs = pa.StructArray.from_arrays([pa.array(edge - base, pa.int64()), pa.array(close - base, pa.int64())], ["start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(words.doc[edge] if len(edge) else edge, np.arange(n + 1)), pa.int32()), runs)
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64()), "n_words": pa.array(np.diff(words.first), pa.int64()), "n_removed": pa.array(np.bincount(words.doc[gone], minlength=n), pa.int64()),
            "kept": kept.cast(pa.string()), "removed": lists,
        })

    with Exchange(docs, scratch or Scratch(docs.sparkSession), key=key, text=text, **{"size": CHUNK_BYTES} | exchange) as ex:
        ex.ask(0, _pass0(window), ["sum", "sum"], ANCHOR_BITS)
        ex.ask(1, _pass1(window), ["min", "same"])
        return ex.visit(final, RESULT)


