"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.frames import texts
from corvane.llm.tokens import encode_text, rank_encoding

def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<long>, n_tokens) of every whole text.

    A null or empty text has no ids; repeated rows give repeated rows, also without an id; other
    columns are left out.  Texts and runs of white space of any length are encoded whole.
    """

    def run(batches):
        enc, _ = rank_encoding(ranks, pattern)
        for b in batches:
            ids = [encode_text(enc, x) if x else np.zeros(0, np.uint32) for x in b.column("text").to_pylist()]
            sizes = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(np.diff(sizes), pa.int64())], ["doc_id", "ids", "n_tokens"])

    return texts(docs, key, text).mapInArrow(run, "doc_id long, ids array<long>, n_tokens long")


def decode(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, bytes binary): the raw bytes that each row's ids spell, and the ids' digest.

    Null ids count as none.  Ids need not end at a character's end: bytes are returned, not text.  A
    row with an id that the rank file doesn't have gets null bytes; the digest covers the ids as they are.
    """

    def run(batches):
        _, table = rank_encoding(ranks, pattern)
        order = sorted(table, key=table.get)
        at = np.concatenate([[0], np.cumsum([len(x) for x in order])])
        data = np.frombuffer(b"".join(order), np.uint8)
        rank = np.array([table[x] for x in order])
        place = np.full(rank[-1] + 1, -1)
        place[rank] = np.arange(len(rank))
        for b in batches:
            lists = b.column("ids")
            out, digests = [], []
            for k in range(len(lists)):
                got = lists[k].values
                ids = np.zeros(0, np.int64) if got is None else np.asarray(got.fill_null(-1))
                digests.append(hashlib.sha256(ids.astype(np.int64).astype("<u4").tobytes()).hexdigest())
                known = (ids >= 0) & (ids < len(place))
                p = place[np.where(known, ids, 0)]
                if not known.all() or (p < 0).any():
                    out.append(None)
                    continue
                n = at[p + 1] - at[p]
                total = np.cumsum(n)
                step = np.repeat(at[p] - (total - n), n)
                out.append(data[step + np.arange(len(step))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(digests, pa.string()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "bytes"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, bytes binary")
