"""Language identification in two steps: the family, then pairs of languages within it.

Linear models over the shares of hashed byte n-grams.  One-versus-rest machines choose the family;
within it a linear support vector machine for every pair of languages votes.  They are fitted on a
bounded sample of labelled documents, whose whole texts are counted on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import words as W
from corvane.llm.frames import sifted, texts

#: Families of languages by ISO 639-1 code (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "lb", "nl", "nb", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayic": ("id", "jv", "ms", "su"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

#: Hash buckets of the n-grams, and bytes of an n-gram.
BUCKETS = 1 << 13
GRAM = 3
#: Labelled documents in the sample for fitting, at most, shared evenly by the languages.
SAMPLE = 2_000
UNKNOWN = "und"


def _buckets(buf: np.ndarray) -> np.ndarray:
    n = max(0, len(buf) - GRAM + 1)
    code = np.zeros(n, np.uint32)
    for j in range(GRAM):
        code |= buf[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    return (code * np.uint32(0x85EBCA6B)) >> np.uint32(19)


@dataclass
class Linear:
    """A linear machine and the slope that turns its margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30)))


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    family_machines: list[Linear] = field(default_factory=list)
    pairs: dict[tuple[str, str], Linear] = field(default_factory=dict)

    def machines(self) -> list[Linear]:
        return [*self.family_machines, *self.pairs.values()]


def train(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> Linear:
    """Linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    scale = np.sqrt((x * x).sum(1)).mean() or 1.0
    x = x / scale
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b, v, c = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    rate = 1 / (2 * 2.0 + penalty)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * weight * y
        nw, nb = v - rate * (penalty * v - 2 * (slack @ x)), c + rate * 2 * slack.sum()
        m = t / (t + 3)
        v, c, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    margin = x @ w + b
    slopes = np.geomspace(0.5, 32, 13)
    loss = [(weight * np.log1p(np.exp(-np.clip(s * y * margin, -30, 30)))).sum() for s in slopes]
    return Linear((w / scale).astype(np.float32), float(b), float(slopes[int(np.argmin(loss))]))


def shares(docs: DataFrame) -> DataFrame:
    """(lang, bucket array<int>, n array<int>): n-gram counts of every whole text."""

    def run(batches):
        for b in (part for batch in batches for part in W.parts(batch)):
            buf, offs = W.utf8(b.column("text"))
            grams = _buckets(W.lower_ascii(buf))
            rows = [np.unique(grams[a : max(a, z - GRAM + 1)], return_counts=True) for a, z in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([b.column("lang"), *(pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (0, 1))], ["lang", "bucket", "n"])

    return docs.mapInArrow(W.tidied(run), "lang string, bucket array<int>, n array<int>")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from rows with a non-null language and text.

    At most about ``sample`` documents, chosen by hash and shared evenly by the languages, are fitted
    on; no label, source or id is a feature.  Without labelled rows the model predicts only ``und``.
    """
    rows = labelled.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null and length(text) >= 3")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return Model()
    each = max(20, sample // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limit = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, each / n))))))
    chosen = rows.where(draw < F.element_at(limit, F.col("lang")))
    got = shares(chosen.select("text", "lang")).collect()  # about `sample` rows
    got.sort(key=lambda r: (r.lang, r.n, r.bucket))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        x[k, r.bucket] = np.array(r.n, np.float32) / sum(r.n)
    langs = np.array([r.lang for r in got])
    of = np.array([FAMILY.get(c, c) for c in langs])
    model = Model(sorted(set(of)), {f: sorted(set(langs[of == f])) for f in sorted(set(of))})
    sides = model.families[:1] if len(model.families) == 2 else model.families if len(model.families) > 2 else []
    model.family_machines = [train(x, np.where(of == f, 1, -1).astype(np.float32)) for f in sides]
    for f in model.families:
        for a, b in combinations(model.languages[f], 2):
            rows_ab = (langs == a) | (langs == b)
            model.pairs[a, b] = train(x[rows_ab], np.where(langs[rows_ab] == a, 1, -1).astype(np.float32))
    return model


def classify(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index over the sorted languages, score) from the margins of ``model.machines()``."""
    n = margins.shape[1]
    k = len(model.family_machines)
    p = np.array([m.probability(margins[i]) for i, m in enumerate(model.family_machines)])
    if len(model.families) == 1:
        p = np.ones((1, n))
    elif len(model.families) == 2:
        p = np.stack([p[0], 1 - p[0]])
    else:
        p = p / np.maximum(p.sum(0), 1e-12)
    names = sorted(c for v in model.languages.values() for c in v)
    family = p.argmax(0)
    out, score = np.zeros(n, np.int64), np.zeros(n)
    pair_at = {ab: k + i for i, ab in enumerate(model.pairs)}
    for f, name in enumerate(model.families):
        own = model.languages[name]
        votes, mass = np.zeros((len(own), n)), np.zeros((len(own), n))
        for (i, a), (j, b) in combinations(enumerate(own), 2):
            q = model.pairs[a, b].probability(margins[pair_at[a, b]])
            votes[i] += q >= 0.5
            votes[j] += q < 0.5
            mass[i] += q
            mass[j] += 1 - q
        best = (votes + mass / (len(own) + 1)).argmax(0)
        within = mass[best, np.arange(n)] / max(1, len(own) - 1) if len(own) > 1 else np.ones(n)
        here = family == f
        out[here] = np.array([names.index(c) for c in own])[best[here]]
        score[here] = (p[f] * within)[here]
    return out, score


def in_training(key: str = "doc_id"):
    """Whether a document may be learned from: crc32 of its id as text, modulo 4, isn't 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2


def has_letter(column, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(letter)])
    found = total[offs[1:]] > total[offs[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offs) > 0)).tolist():
        found[k] = any(c.isalpha() for c in column[k].as_py())
    return found


def _judge(m: Model):
    """(texts) -> (languages, scores) of a batch, by the model."""
    names = np.array([*sorted(c for v in m.languages.values() for c in v), UNKNOWN])
    table = np.array([x.weights for x in m.machines()], np.float32).reshape(-1, BUCKETS)
    bias = np.array([x.bias for x in m.machines()])

    def judge(column) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(column, "")
        buf, offs = W.utf8(column)
        rows = len(column)
        known = has_letter(column, buf, offs) if m.families else np.zeros(rows, bool)
        grams = _buckets(W.lower_ascii(buf))
        start, n = offs[:-1], np.maximum(np.diff(offs) - GRAM + 1, 0)
        stop = np.minimum(start + n, len(grams))
        margins = np.empty((len(table), rows))
        for k, weights in enumerate(table):
            total = np.concatenate([[0.0], np.cumsum(weights.take(grams), dtype=np.float64)])
            margins[k] = (total[stop] - total[np.minimum(start, len(grams))]) / np.maximum(n, 1) + bias[k]
        lang, score = classify(m, margins) if m.families else (np.zeros(rows, np.int64), np.zeros(rows))
        return names[np.where(known, lang, len(names) - 1)], np.where(known, score, 0.0)

    return judge


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages.
    Repeated rows give repeated rows; equal texts get equal predictions; languages with equal votes
    and probabilities go to the first by name.  Rows without an id are predicted too.  A text of any
    length is read whole, those above 2 MB one at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = _judge(shared.value)
        for b in (part for batch in batches for part in W.parts(batch)):
            lang, score = judge(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return texts(docs, key, text).mapInArrow(W.tidied(run), "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def verdict(_, column):
        lang, score = _judge(shared.value)(column)
        return pa.array((lang != UNKNOWN) & (score >= least))

    return sifted(docs, verdict, key, text)
