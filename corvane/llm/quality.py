"""Quality rules: text statistics, then a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams, one of trusted documents and one of the raw corpus, give
every document the mean log ratio of its n-grams; it is kept if that mean reaches the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import words as W
from corvane.llm.frames import sifted, texts

#: Buckets of the hashed n-grams: both tables together are 1 MB, whatever the corpus.
BUCKETS = 1 << 16
#: Bytes of an n-gram.
GRAM = 4
#: Trusted documents that the target multinomial is fitted on, at most; the raw counts cover all.
TRUSTED = 20_000
#: Mean natural-log ratio below which a document goes.
THRESHOLD = -0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def gram_buckets(buf: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last GRAM - 1 positions have none)."""
    n = max(0, len(buf) - GRAM + 1)
    code = np.zeros(n, np.uint32)
    for j in range(GRAM):
        code |= buf[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _own(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First n-gram and number of n-grams that lie inside each document."""
    return offs[:-1], np.maximum(np.diff(offs) - GRAM + 1, 0)


def _sums(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    stop = np.minimum(start + count, len(values))
    return total[stop] - total[np.minimum(start, len(values))]


def target_ids(trusted: DataFrame, bound: int = TRUSTED) -> np.ndarray:
    """Sorted ids of at most ``bound`` trusted documents, those with the least hash; null ids don't count."""
    rows = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return np.sort(np.array([r.doc_id for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()], np.int64))


def gram_counts(docs: DataFrame, target: np.ndarray) -> DataFrame:
    """(bucket, raw, target): counts over all documents, and over those of the target sample.

    Every task adds up its own documents and gives a row per bucket; Spark adds these up by bucket, in
    tasks before the shuffle and after it, so no group grows beyond one row of each task.
    """
    ids = docs.sparkSession.sparkContext.broadcast(target)

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in (part for batch in batches for part in W.parts(batch)):
            buf, offs = W.utf8(b.column("text"))
            start, n = _own(offs)
            mark = np.zeros(len(buf) + 1, np.int8)
            np.add.at(mark, start, (n > 0).astype(np.int8))
            np.subtract.at(mark, start + n, (n > 0).astype(np.int8))
            inside = np.cumsum(mark[: max(0, len(buf) - GRAM + 1)], dtype=np.int8).astype(bool)
            grams = gram_buckets(buf)
            own = b.column("doc_id").fill_null(-1 << 63).to_numpy()
            chosen = np.repeat(np.isin(own, ids.value), np.diff(offs))[: len(grams)]
            raw += np.bincount(grams[inside], minlength=BUCKETS)
            target += np.bincount(grams[inside & chosen], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some], pa.int64()), pa.array(target[some], pa.int64())], ["bucket", "raw", "target"])

    return docs.mapInArrow(W.tidied(count), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket, add-one smoothed; zero where there is no trusted text."""
    if not target.sum():
        return np.zeros(len(raw))
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def statistics(column) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The counts of each text of a column, and its (bytes, offsets)."""
    buf, offs = W.utf8(column)
    n = len(offs) - 1
    start, end, doc = W.spans(buf, offs)
    per = lambda at, w=None: np.bincount(at, weights=w, minlength=n).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = points[end] - points[start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL.take(buf))])
    hashes = W.span_hashes(buf, start, end)
    # Lines with a word, by their exact bytes.
    feeds = np.flatnonzero(buf == 10)
    edge = np.unique(np.concatenate([offs[:-1], feeds + 1, offs[1:]]))
    line = np.unique(np.searchsorted(edge, start, "right") - 1)
    lo, hi = edge[line], edge[np.minimum(line + 1, len(edge) - 1)]
    hi = hi - ((hi > lo) & (buf[np.maximum(hi - 1, 0)] == 10)) if len(line) else hi
    of = np.searchsorted(offs, lo, "right") - 1
    same = W.span_hashes(buf, lo, hi) ^ W.mix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(same, kind="stable")
    again = np.zeros(len(line), bool)
    again[order[1:]] = same[order][1:] == same[order][:-1]
    # Words in three-word windows that the text has twice or more.
    covered = np.zeros(len(start), bool)
    inner = np.flatnonzero(W.inside(doc, 3))
    if len(inner):
        tri = W.grams(hashes, 3)[inner] ^ W.mix(doc[inner].astype(np.uint64) + np.uint64(1))
        order = np.argsort(tri)
        eq = tri[order][1:] == tri[order][:-1]
        twice = np.zeros(len(inner), bool)
        twice[order[1:][eq]] = True
        twice[order[:-1][eq]] = True
        for j in range(3):
            covered[inner[twice] + j] = True
    out = {
        "n_words": per(doc), "word_chars": per(doc, chars), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
        "n_dup_lines": per(of[again]), "n_repeat_words": per(doc[covered]),
    }
    return out, (buf, offs)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _table(docs: DataFrame, trusted: DataFrame):
    """The log ratio of each bucket, on its way to the executors."""
    rows = gram_counts(docs, target_ids(trusted)).collect()  # BUCKETS rows at most, of three numbers
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return docs.sparkSession.sparkContext.broadcast(ratios(raw, target))


def _verdicts(column, table: np.ndarray, threshold: float):
    """(statistics, whether the rules failed, whether kept, score) of each text."""
    stats, (buf, offs) = statistics(column)
    start, n = _own(offs)
    score = _sums(table.take(gram_buckets(buf)), start, n) / np.maximum(n, 1)
    failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
    return stats, failed, ~failed & (score >= threshold), score


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, likelihood-ratio score and verdict of every document.

    ``trusted`` has the doc_ids of trusted documents, of which the target sample is drawn.  A null or
    empty text has no words and fails; a text shorter than an n-gram scores 0.  A score equal to the
    threshold is kept.  Without trusted documents every score is 0.  Repeated rows give repeated rows,
    equal texts equal scores; rows without an id are judged too, and are never trusted.  A text of any
    length is read whole, those above 2 MB one at a time.
    """
    docs = texts(docs, key, text)
    table = _table(docs, trusted)

    def run(batches):
        for b in (part for batch in batches for part in W.parts(batch)):
            stats, failed, kept, score = _verdicts(b.column("text"), table.value, threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in stats.values()), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *stats, "base_failed", "kept", "score"])

    return docs.mapInArrow(W.tidied(run), RESULT)


def keep(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``judge`` keeps."""
    table = _table(texts(docs, key, text), trusted)
    return sifted(docs, lambda _, column: pa.array(_verdicts(column, table.value, threshold)[2]), key, text)
