"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Every line with a word is a paragraph.  A multinomial logistic regression over hashed word uni- and
bigrams names the licence family or ``unknown``; a family stands only if its calibrated probability
reaches the limit and enough of the paragraph is found in one of the family's templates.

Notices inside longer lines, notices wrapped over lines and the paragraphs of whole licences are found
by windows: for every template, each run of a text's words as long as the template, whatever line
breaks it has, that holds enough of the template's bigrams.  The classifier must agree on the window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import words as W
from corvane.llm.frames import texts

# Notices of public licences (fixed values).
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "SPDX-License-Identifier: MIT",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
}
UNKNOWN = "unknown"
BUCKETS = 1 << 15
#: Paragraphs of the corpus that stand for ``unknown`` in training, about.
SAMPLE = 4_000
#: Least calibrated probability, and least share of a paragraph's bigrams found in a template, or of a
#: template's bigrams found in a window.
LIMIT, ALIKE = 0.5, 0.6
#: Least words of a paragraph of a whole licence that makes a template.
BODY = 9


def bodies() -> dict[str, list[str]]:
    """The paragraphs of the whole licence texts in ``licences``, of BODY words at least."""
    out: dict[str, list[str]] = {}
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        found = (" ".join(p.split()) for p in re.split(r"\n\s*\n", path.read_text("utf-8")))
        out[path.stem] = [p for p in found if len(p.split()) >= BODY]
    return out


def _words(column):
    """(bytes, offsets, start, end, hash, plain) of the words; ``plain`` ones have letters or digits."""
    buf, offs = W.utf8(column)
    start, end, doc = W.spans(buf, offs)
    # Punctuation at a word's edge doesn't count: its hash is that of the letters and digits inside.
    low = W.lower_ascii(buf)
    plain = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    ends = np.concatenate([[0], np.cumsum(plain)])
    some = ends[end] > ends[start]
    where = np.flatnonzero(plain)
    first = np.where(some, where[np.minimum(ends[start], len(where) - 1)] if len(where) else start, start)
    last = np.where(some, where[np.maximum(ends[end] - 1, 0)] + 1 if len(where) else end, end)
    return buf, offs, start, end, doc, W.span_hashes(low, first, last), some


def features(column, known=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, paragraph) of every feature, and (document, start, end) of every paragraph, in bytes."""
    buf, offs, start, end, _, h, _ = known or _words(column)
    edge = np.unique(np.concatenate([offs[:-1], np.flatnonzero(buf == 10) + 1, offs[1:]]))
    at = np.searchsorted(edge, start, "right") - 1
    lines, para = np.unique(at, return_inverse=True)
    two = W.inside(para, 2)
    pair = W.grams(h, 2)[two]
    shift = np.uint64(64 - 15)
    bucket = np.concatenate([W.mix(h) >> shift, pair >> shift]).astype(np.int64)
    owner = np.concatenate([para, para[:-1][two] if len(para) else para])
    lo, hi = edge[lines], edge[np.minimum(lines + 1, len(edge) - 1)]
    return bucket, owner, np.searchsorted(offs, lo, "right") - 1, lo, hi


def bigrams(text: str) -> set[int]:
    column = pa.array([text.replace("\n", " ")])
    bucket, owner, *_ = features(column)
    n = (len(bucket) + 1) // 2
    return set(bucket[n:].tolist()) or set(bucket.tolist())


class Passages:
    """All templates, notices and paragraphs of whole licences, ready for the search of windows."""

    def __init__(self):
        named = {f: [*v, *bodies().get(f, [])] for f, v in TEMPLATES.items()}
        self.family, self.length, own = [], [], []
        for f, v in named.items():
            for t in v:
                *_, h, some = _words(pa.array([t]))
                g = W.grams(h[some], 2)
                if len(g):
                    self.family.append(f)
                    self.length.append(len(g))
                    own.append(np.unique(g))
        self.terms, index = np.unique(np.concatenate(own), return_inverse=True)
        self.edge = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        self.of = index
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def windows(self, h: np.ndarray, doc: np.ndarray):
        """(template, first word, last word, similarity) of the windows, by template and place.

        ``h`` and ``doc`` are the plain words.  A window starts at a bigram of the template and is as
        long as the template; its similarity is the share of the template's distinct bigrams in it.
        """
        if len(h) < 2:
            return
        pair = W.grams(h, 2)
        at = np.flatnonzero(self.quick[(pair >> np.uint64(44)).astype(np.int64)] & W.inside(doc, 2))
        term = np.minimum(np.searchsorted(self.terms, pair[at]), len(self.terms) - 1)
        real = self.terms[term] == pair[at]
        at, term = at[real], term[real]
        order = np.argsort(term, kind="stable")
        lo = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        there = lo[1:] > lo[:-1]
        size = np.diff(self.edge)
        enough = np.add.reduceat(there[self.of].astype(np.int64), self.edge[:-1]) >= ALIKE * size
        for t in np.flatnonzero(enough).tolist():
            n, span = int(size[t]), self.length[t]
            mine = self.of[self.edge[t] : self.edge[t + 1]]
            each = [at[order[lo[x] : lo[x + 1]]] for x in mine.tolist()]
            # A bigram counts in the windows that start after its last occurrence before, so each counts once.
            place = np.concatenate(each)
            before = np.concatenate([np.concatenate([[-1], x[:-1]]) if len(x) else x for x in each])
            opens, closes, start = np.sort(np.maximum(before + 1, place - span + 1)), np.sort(place) + 1, np.sort(place)
            limit = np.searchsorted(doc, doc[start], "right") - 1  # the last word of the start's document
            # Windows end with their document: bigrams of the next one are taken off where they would count.
            count = np.searchsorted(opens, start, "right") - np.searchsorted(closes, start, "right")
            over = np.flatnonzero((start + span > limit) & (count >= ALIKE * n))
            for i in over.tolist():
                j = np.searchsorted(start, min(start[i] + span, limit[i]))
                count[i] = len(np.unique(pair[start[i:j]])) if j - i < 4 * span else count[i]
            good = np.flatnonzero(count >= ALIKE * n)
            i = 0
            while i < len(good):
                stop = int(np.searchsorted(start[good], start[good[i]] + span))
                best = good[i + int(np.argmax(count[good[i:stop]]))]
                last = start[np.searchsorted(start, min(start[best] + span, limit[best])) - 1] + 1
                yield t, int(start[best]), int(last), float(count[best] / n)
                i = int(np.searchsorted(start[good], last))


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # (families + 1 for unknown, BUCKETS)
    bias: np.ndarray
    temperature: float


def _softmax(z):
    z = np.exp(z - z.max(0))
    return z / z.sum(0)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fits on the templates, with words left out or changed at random, against paragraphs of the corpus.

    The corpus gives about ``sample`` paragraphs, one each of documents chosen by the hash of their
    ids; those much like a template are not used.  The temperature is calibrated on templates that
    the weights haven't seen, where a family has several, and on the other half of the corpus' paragraphs.
    """
    rng = np.random.default_rng(seed)
    names = [*sorted(TEMPLATES), UNKNOWN]
    lines, labels, whole, aside = [], [], bodies(), []
    for k, name in enumerate(names[:-1]):
        for i, (t, times) in enumerate([*((t, 40) for t in TEMPLATES[name]), *((t, 4) for t in whole.get(name, []))]):
            for _ in range(times):
                lines.append(" ".join([w for w in t.split() if rng.random() > 0.08] or t.split()))
                labels.append(k)
                aside.append(i % 4 == 2)
    # A bound on the hash of the id chooses about `sample` documents: nothing is sorted, and no text moves.
    rows = texts(docs, key, text).where("text is not null")
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen_rows = rows.where(draw < F.lit(int((1 << 30) * min(1.0, sample / max(n, 1)))))
    paragraphs = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    chosen = chosen_rows.select("doc_id", paragraphs.alias("p")).where(F.size("p") > 0)
    # A whole text gives one paragraph, chosen by its own hash; rows that repeat an id give one together.
    line = F.get("p", F.pmod(F.xxhash64("doc_id"), F.size("p").cast("long")).cast("int"))
    picked = chosen.groupBy("doc_id").agg(F.min(line).alias("line")).orderBy("doc_id")
    known = [bigrams(t) for v in TEMPLATES.values() for t in v]
    passages = Passages()
    for r in picked.collect():
        *_, doc, h, some = _words(pa.array([r.line]))
        if next(passages.windows(h[some], doc[some]), None):
            continue
        own = bigrams(r.line)
        if own and max(len(own & t) for t in known) < 0.3 * len(own):
            lines.append(r.line)
            labels.append(len(names) - 1)
            aside.append(len(lines) % 2 == 0)
    y = np.array(labels)
    bucket, owner, *_ = features(pa.array([x.replace("\n", " ") for x in lines]))
    size = np.bincount(owner, minlength=len(lines))
    used, col = np.unique(bucket, return_inverse=True)
    value = 1 / np.sqrt(size[owner])
    aside = np.array(aside)

    def weights(train):
        w, b = np.zeros((len(names), len(used))), np.zeros(len(names))
        share = np.bincount(y, weights=train, minlength=len(names))
        each = train / np.maximum(share[y], 1)
        for _ in range(120):
            z = scores(w, b)
            g = (_softmax(z) - np.eye(len(names))[:, y]) * each
            for k in range(len(names)):
                w[k] -= 4 * (np.bincount(col, weights=value * g[k][owner], minlength=len(used)) + 1e-5 * w[k])
            b -= 1.0 * g.sum(1)
        return w, b

    def scores(w, b):
        return np.stack([np.bincount(owner, weights=value * w[k][col], minlength=len(y)) for k in range(len(names))]) + b[:, None]

    # The temperature comes from weights that haven't seen the templates it is measured on; all are used in the end.
    z = scores(*weights(~aside))
    heats = np.geomspace(0.05, 4, 20)
    loss = [-np.log(np.maximum(_softmax(z / t)[y, np.arange(len(y))], 1e-12))[aside].mean() if aside.any() else 0.0 for t in heats]
    w, b = weights(np.ones(len(y), bool))
    full = np.zeros((len(names), BUCKETS))
    full[:, used] = w
    return Model(names, full, b, float(heats[int(np.argmin(loss))]))


HIT = "array<struct<family:string,start:long,stop:long,probability:double,similarity:double>>"


def _add_windows(hits: dict[int, list], found, m: Model, passages: Passages) -> None:
    """Adds the windows that the classifier agrees on to the paragraphs in ``hits``.

    Of windows that overlap, that with most of its template stands.  A window inside a paragraph that
    is a hit says nothing new; one that goes beyond takes in the paragraphs of its family it meets.
    """
    _, offs, start, end, doc, h, some = found
    start, end, doc, h = start[some], end[some], doc[some], h[some]
    by_doc: dict[int, list] = {}
    for t, first, last, alike in passages.windows(h, doc):
        one = h[first : last + 1]
        bucket = (np.concatenate([W.mix(one), W.grams(one, 2)]) >> np.uint64(64 - 15)).astype(np.int64)
        p = _softmax(((m.weights[:, bucket].sum(1) / np.sqrt(len(bucket)) + m.bias) / m.temperature)[:, None])[:, 0]
        k = int(p[:-1].argmax())
        if p[k] >= LIMIT and m.families[k] == passages.family[t]:
            d = int(doc[first])
            by_doc.setdefault(d, []).append((-alike * passages.length[t], int(start[first] - offs[d]), int(end[last] - offs[d]), m.families[k], float(p[k]), alike))
    for d, windows in by_doc.items():
        lines, kept = hits.get(d, []), []
        for _, a, e, family, p, alike in sorted(windows):
            if any(x["start"] <= a and e <= x["stop"] for x in lines) or any(a < x["stop"] and x["start"] < e for x in kept):
                continue
            kept.append({"family": family, "start": a, "stop": e, "probability": p, "similarity": alike})
        for w in kept:
            a, e = w["start"], w["stop"]
            met = [x for x in lines if x["start"] < e and a < x["stop"] and (x["family"] == w["family"] or (a <= x["start"] and x["stop"] <= e))]
            for x in met:
                if x["family"] == w["family"]:
                    w["start"], w["stop"] = min(w["start"], x["start"]), max(w["stop"], x["stop"])
            lines = [x for x in lines if not any(x is y for y in met)]
        hits[d] = sorted([*lines, *kept], key=lambda x: (x["start"], x["stop"]))


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, hits): the confirmed licence paragraphs and windows of every whole text.

    ``start`` and ``stop`` are byte positions in the UTF-8 text.  A null or empty text has no
    paragraphs; repeated rows give repeated rows, also without an id.  Of families with equal
    probability the first by name is meant.  A text of any length is read whole, those above 2 MB one
    at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, Passages()))

    def run(batches):
        m, passages = shared.value
        known = {f: [bigrams(t) for t in v] for f, v in TEMPLATES.items()}
        for b in (part for batch in batches for part in W.parts(batch)):
            found = _words(b.column("text"))
            bucket, owner, doc, lo, hi = features(None, found)
            n = len(doc)
            offs = found[1]
            size = np.bincount(owner, minlength=n)
            scale = 1 / np.sqrt(np.maximum(size, 1))
            z = np.stack([np.bincount(owner, weights=m.weights[k].take(bucket), minlength=n) * scale for k in range(len(m.families))]) + m.bias[:, None] if n else np.zeros((len(m.families), 0))
            hits: dict[int, list] = {}
            if n:
                p = _softmax(z / m.temperature)
                best = p[:-1].argmax(0)
                column = b.column("text")
                for k in np.flatnonzero(p[:-1].max(0) >= LIMIT).tolist():
                    d = int(doc[k])
                    a, e = int(lo[k] - offs[d]), int(hi[k] - offs[d])
                    raw = column[d].as_py().encode("utf-8")[a:e].rstrip(b"\n")
                    own = bigrams(raw.decode("utf-8"))
                    family = m.families[best[k]]
                    alike = max(len(own & t) / max(1, len(own)) for t in known[family])
                    if alike >= ALIKE:
                        hits.setdefault(d, []).append({"family": family, "start": a, "stop": a + len(raw), "probability": float(p[best[k], k]), "similarity": alike})
            _add_windows(hits, found, m, passages)
            rows = b.num_rows
            kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(doc, minlength=rows)[:rows], pa.int64()), pa.array([hits.get(k, []) for k in range(rows)], kind)], ["doc_id", "n_paragraphs", "hits"])

    return texts(docs, key, text).mapInArrow(run, f"doc_id long, n_paragraphs long, hits {HIT}")
