"""Byte-level BPE ids of whole Arrow batches.

The split pattern of byte-level BPE never lets a match run from a character that isn't white space
into a following space.  A text may therefore be cut before any space that follows such a
character, and the ids of the pieces, one after the other, are those of the text.  Invented or
natural prose repeats few distinct pieces, so each distinct piece of a batch is encoded once and its
ids are gathered by index.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from corvane.llm.words import span_hashes, utf8

#: Bytes of text looked up at once; a longer text is looked up alone.
AT_ONCE = 4 << 20

#: Distinct pieces whose ids a worker keeps; beyond it the store starts anew (results don't change).
KEPT_PIECES = 2_000_000
#: Pieces encoded as one text.
JOINED = 256


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions of spaces before which a text may be cut.

    A cut needs an ASCII character above space before it, or the end of a longer character that
    certainly isn't white space: two-byte characters starting with C2 and three-byte ones with E1 to
    E3 are left alone, as the white space outside ASCII is among them.
    """
    if len(buf) < 2:
        return np.zeros(0, np.int64)
    p = np.flatnonzero(buf[1:] == 32) + 1
    return p[_ends_dark(buf, p)]


def _ends_dark(buf: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character before each position certainly isn't white space."""
    last, two, three = buf[end - 1], buf[np.maximum(end - 2, 0)], buf[np.maximum(end - 3, 0)]
    wide = (last >= 128) & (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))
    return ((last > 32) & (last < 127)) | wide


class Pieces:
    """Ids of whole columns.

    ``encode`` maps a list of texts to lists of ids, ``n_bytes`` has the number of bytes of each id.
    As the ids of a text spell its bytes, the ids of joined pieces are told apart by counting bytes.
    """

    def __init__(self, encode, n_bytes):
        self.encode, self.n_bytes = encode, np.asarray(n_bytes, np.int64)
        self.reset()

    def reset(self):
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, keys, buf, start, end):
        joins = (buf[start] == 32) & _ends_dark(buf, end)
        order = np.argsort(~joins, kind="stable")
        keys, start, end = keys[order], start[order], end[order]
        n = int(joins.sum())
        view = buf.tobytes()
        parts = [view[a:b] for a, b in zip(start.tolist(), end.tolist())]
        texts = [b"".join(parts[i : min(i + JOINED, n)]) for i in range(0, n, JOINED)] + parts[n:]
        new = self.encode([str(x, "utf-8") for x in texts])
        flat = np.concatenate([np.asarray(x, np.uint32) for x in new])
        spelt = np.cumsum(self.n_bytes[flat])
        stops = np.searchsorted(spelt, np.cumsum(end - start)) + 1
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, len(self.ids) + stops])
        self.ids = np.concatenate([self.ids, flat])
        keys = np.concatenate([self.keys, keys])
        slot = np.concatenate([self.slot, first + np.arange(len(parts))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of a column; null counts as the empty text.

        The index arrays take many times a text's bytes, so a batch is worked on in parts.
        """
        buf, offs = utf8(column)
        ids, sizes, a = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while a < len(offs) - 1:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + AT_ONCE, "right")) - 1)
            found, at = self._part(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            ids.append(found)
            sizes.append(np.diff(at))
            a = b
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _part(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.sort(np.concatenate([cuts(buf), offs]), kind="stable")  # two sorted runs
        edge = edge[np.concatenate([edge[:-1] != edge[1:], [True]])]
        start, end = edge[:-1], edge[1:]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        keys = span_hashes(buf, start, end)
        uniq, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > KEPT_PIECES:
            self.reset()
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            known = self.keys[at] == uniq
        if not known.all():
            miss = first[~known]
            self._learn(uniq[~known], buf, start[miss], end[miss])
        slot = self.slot[np.searchsorted(self.keys, uniq)][back]
        lo, n = self.at[slot], self.at[slot + 1] - self.at[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(lo - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(edge, offs)]


#: Characters from which on a text is cut at safe boundaries before it is encoded, and a run of white space by itself.
LONG, LONG_RUN = 1 << 16, 1 << 12
#: White space as the pattern means it: Unicode's property of that name (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def split_safely(text: str, longest: int = LONG) -> list[tuple[str, bool]]:
    """(piece, whether it is one match of the pattern): pieces whose ids, one after the other, are those of the text.

    A long run of white space is one match without its last character, or whole at the text's end;
    the regex engine's stack would overflow on it.  Elsewhere pieces have about ``longest`` bytes and
    cuts lie only before a space that follows a character that isn't white space; a part without such
    a place stays whole.
    """
    if len(text) <= min(longest, LONG_RUN):
        return [(text, False)]
    out, done = [], 0
    for run in _RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += [*_at_spaces(text[done : run.start()], longest), (text[run.start() : stop], True)]
        done = stop
    return out + _at_spaces(text[done:], longest)


def _at_spaces(text: str, longest: int) -> list[tuple[str, bool]]:
    if len(text) <= longest:
        return [(text, False)] if text else []
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    at = cuts(raw)
    if not len(at):
        return [(text, False)]
    chosen = at[np.unique(np.searchsorted(at, np.arange(longest, len(raw), longest)).clip(max=len(at) - 1))]
    edge = [0, *chosen.tolist(), len(raw)]
    data = raw.tobytes()
    return [(str(data[a:b], "utf-8"), False) for a, b in zip(edge, edge[1:])]


def encode_text(enc, text: str) -> np.ndarray:
    """The ids that the pattern and ranks of a tiktoken encoding give a text of any length."""
    ids = [np.asarray(enc._encode_single_piece(x) if one else enc.encode_ordinary(x), np.uint32) for x, one in split_safely(text)]
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32)


@lru_cache(4)
def bpe_pieces(path: str) -> Pieces:
    """Pieces encoded by the tokenizers library from a byte-level BPE file; special strings are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    vocab = tok.get_vocab(with_added_tokens=False)
    n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        n_bytes[i] = len(token)
    return Pieces(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], n_bytes)


@lru_cache(4)
def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding of a local rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


@lru_cache(4)
def rank_pieces(path: str, pattern: str) -> Pieces:
    enc, ranks = rank_encoding(path, pattern)
    n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        n_bytes[i] = len(token)
    return Pieces(lambda texts: [encode_text(enc, x) for x in texts], n_bytes)
