"""LM scoring with a probabilistic suffix tree over words.

The root predicts by add-one word frequencies.  A context of one to ``depth`` words is kept as a state
if what follows it diverges enough from what follows its own suffix.  A state's next-symbol
distribution has the counts of the words that followed it twice or more; the mass of all others, and a
prior, is spread as the distribution of the next shorter state.  A token is scored by the longest
suffix of its history that is a state.

Counts cover all training documents, and every context that occurs twice is tested, at every size of
the corpus.  They are gathered in passes over the corpus (see ``exchange``): the occurrences of words,
of pairs, and so on, each pass asking only about sequences whose parts occur twice; then what
follows the contexts of all lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm import words as W
from corvane.llm.exchange import Exchange, Replies, dump, load
from corvane.llm.frames import Scratch

#: Longest context, in words.
DEPTH = 3
#: Least training occurrences of a context, and of a word after it that gets a count of its own.
LEAST = 2
#: A context is a state if its divergence from its suffix (nats) is so much per occurrence, and in all.
DIVERGENCE, EVIDENCE = 0.02, 0.64
#: Occurrences added to what a state leaves to the next shorter one.
PRIOR = 2.0
#: Bytes of text up to which 48 bits name an event; then 64.  Two events with one name in 10 ** 7, say,
#: count as one.
SHORT_NAMES = 1 << 36
END = np.uint64(0x5851F42D4C957F2D)


def in_training(doc_id: int, modulus: int = 7, held: int = 2) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus != held


def tokens(ids: pa.Array, text: pa.Array) -> bytes:
    """A chunk's body: its documents' ids and sizes, its tokens as numbers, and the tokens' hashes.

    Tokens are lower-cased words and one end per document, also of an empty one.
    """
    buf, offs = W.utf8(text)
    buf = W.lower_ascii(buf)
    start, end, doc = W.spans(buf, offs)
    stops = W.first_of(doc, len(ids))[1:]
    uniq, _, index = W.distinct(np.insert(W.span_hashes(buf, start, end), stops, END))
    size = np.diff(np.concatenate([[0], stops])) + 1
    body = dump([ids.to_numpy(zero_copy_only=False).astype(np.int64), size, uniq[:1], np.diff(uniq), index.astype(np.uint32)])
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


class Tokens:
    def __init__(self, body: bytes):
        self.ids, size, first, step, self.index = load(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True))
        self.uniq = np.concatenate([first, first[:1] + np.cumsum(step, dtype=np.uint64)]).astype(np.uint64)
        self.n = len(size)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), size)
        self.offset = (np.arange(len(self.doc)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self.hash = self.uniq[self.index]
        self.train = np.repeat(np.array([in_training(i) for i in self.ids.tolist()], bool), size)


class _Events:
    """Sequences of order + 1 tokens where they may occur twice: positions of their last tokens, keys, one position of each."""

    def __init__(self, t: Tokens, order: int, counts: np.ndarray, bits: int):
        often = counts >= LEAST
        may = often & (t.offset >= order)
        may[1:] &= often[:-1]
        self.at = np.flatnonzero(may)
        self.keys, some, self.index = W.distinct(W.grams(t.hash, order + 1, at=self.at - order) >> np.uint64(64 - bits))
        self.some = self.at[some]
        self.train = np.bincount(self.index, weights=t.train[self.at], minlength=len(self.keys)).astype(np.int64)


class _View:
    """What a chunk knows of its tokens after the passes so far: counts of the sequences that end at each.

    Pass k gives the counts of sequences of k + 1 tokens, pass depth + 1 the states.
    """

    def __init__(self, t: Tokens, replies: Replies, orders: int, bits: int):
        got = replies[0]
        self.t, self.counts = t, [got[1].astype(np.int64)[t.index] if got is not None else np.zeros(len(t.index), np.int64)]
        self.owned: list[np.ndarray] = []
        for k in range(1, orders + 1):
            e = _Events(t, k, self.counts[-1], bits)
            got, c = replies[k], np.zeros(len(t.index), np.int64)
            if got is not None:
                c[e.at] = got[1].astype(np.int64)[e.index]
            self.counts.append(c)
            self.owned.append(e.some[got[0]] if got is not None else e.some[:0])

    def contexts(self, k: int, total: float):
        """The contexts of k words that occur twice: (position after each, occurrences, those of what follows, its share after the context's suffix)."""
        before = self.counts[k - 1][:-1]
        at = np.flatnonzero((self.t.offset[1:] >= k) & (before >= LEAST)) + 1
        shorter = total if k == 1 else self.counts[k - 2][at - 1]
        return at, before[at - 1], self.counts[k][at], self.counts[k - 1][at] / shorter

    def evidence(self, depth: int, total: float, bits: int):
        """(keys, numbers) to ask about contexts, and the keys' indexes at each order's positions, -1 where nothing is asked.

        An event is added up by the chunk that owns it, so each counts once.  Where all but one of a
        context's occurrences have the same word after them nothing is open, and only the owner asks.
        """
        keys, parts, places = [], [], []
        for k in range(1, depth + 1):
            at, n, c, share = self.contexts(k, total)
            mine = np.zeros(len(self.t.index), bool)
            mine[self.owned[k - 1]] = True
            mine = mine[at] & (c >= LEAST)
            asks = np.flatnonzero(mine | (n - c > 1))
            key, some, index = W.distinct(W.grams(self.t.hash, k, 1, at=at[asks] - k) >> np.uint64(64 - bits))
            own = np.flatnonzero(mine[asks])
            add = lambda x: np.bincount(index[own], weights=x, minlength=len(key))  # noqa: B023, E731
            cc, nn, ss = (x[asks][own].astype(float) for x in (c, n, share))
            parts.append((n[asks][some], add(cc).astype(np.int64), add(cc * np.log(cc / (nn * ss))).astype(np.float32), add(ss).astype(np.float32)))
            place = np.full(len(at), -1)
            place[asks] = index + sum(map(len, keys))
            keys.append(key)
            places.append(place)
        key = np.concatenate(keys)
        order = np.argsort(key)
        rank = np.empty(len(order) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(order)), -1
        return key[order], [np.concatenate(x)[order] for x in zip(*parts)], [rank[p] for p in places]

    def probabilities(self, depth: int, total: float, words: int, got, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(by the root, by the longest state) of every token."""
        root = (self.counts[0] + 1) / (total + words + 1)
        out, places = root.copy(), self.evidence(depth, total, bits)[2]
        for k in range(1, depth + 1):
            at, n, c, share = self.contexts(k, total)
            own = np.where(c >= LEAST, c, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                kept = _kept(n, own, own * np.log(own / (n * share)), share)
            asked = places[k - 1] >= 0
            if got is not None:
                kept[asked] = got[1].astype(np.int64)[places[k - 1][asked]]
            state = kept > 0
            p = (own + (n - kept + PRIOR) * out[at]) / (n + PRIOR)
            out[at[state]] = p[state]
        return root, out


def _kept(n, kept, gain, covered):
    """The occurrences that a state counts by themselves; 0 where the context is no state.

    The divergence takes all other words after the context as one, with what they have after its suffix.
    """
    rest = np.maximum(n - kept, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = np.where(rest > 0, rest * np.log(rest / n / np.maximum(1 - covered, 1e-12)), 0.0)
    return np.where((kept > 0) & (np.nan_to_num(gain) + tail >= np.maximum(DIVERGENCE * n, EVIDENCE)), kept, 0)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, depth: int = DEPTH, key: str = "doc_id", text: str = "text", **exchange) -> DataFrame:
    """Scores every whole text by a tree learned from the documents in training.

    A null or empty text is its end alone.  Without training documents all tokens are equally likely.
    Rows without an id are left out; repeated rows are learned from and scored each.  A text longer
    than a chunk is a chunk of its own.  Contexts are tested up to ``depth`` words (1 to 7), or as
    long as any occurs twice.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch, Exchange(docs, scratch, tokens, Tokens, key, text, **exchange) as ex:
        bits = 48 if ex.n_bytes < SHORT_NAMES else 64

        def words_of(t, _):
            return t.uniq, (np.bincount(t.index, weights=t.train, minlength=len(t.uniq)).astype(np.int64),)

        words, total = ex.ask(0, words_of, ["sum"])

        def events_of(order):
            def keys_of(t, replies):
                e = _Events(t, order, _View(t, replies, order - 1, bits).counts[-1], bits)
                return e.keys, (e.train,)

            return keys_of

        reached = 0
        for k in range(1, depth + 1):
            found, _ = ex.ask(k, events_of(k), ["sum"], bits)
            reached = k
            if not found:
                break

        def contexts_of(t, replies):
            return _View(t, replies, reached, bits).evidence(reached, total, bits)[:2]

        ex.ask(depth + 1, contexts_of, ["max", "sum", "sum", "sum"], bits, finish=lambda x: [_kept(*x)])

        def final(t: Tokens, replies: Replies) -> pa.Table:
            v = _View(t, replies, reached, bits)
            per = lambda x=None: np.bincount(t.doc, weights=x, minlength=t.n)
            root, best = v.probabilities(reached, total, words, replies[depth + 1], bits)
            return pa.table({
                "doc_id": pa.array(t.ids, pa.int64()), "held_out": pa.array([not in_training(i) for i in t.ids.tolist()], pa.bool_()), "n_tokens": pa.array(per(), pa.int64()), "n_known": pa.array(per(v.counts[0] > 0).astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(t.n, int(total)), pa.int64()), "base_score": pa.array(per(np.log10(root))), "score": pa.array(per(np.log10(best))),
            })

        return Scratch(spark).store(ex.visit(final, RESULT), "scores")
