"""The operators against brute force and round trips on small, awkward documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe_codec, language_id, license_scan, near_duplicates, oracles, packing, quality, queries, substring_dedup, suffix_tree, tiff, token_counts
from corvane.llm import words as W
from corvane.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS, PATTERN, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def corpus():
    rng = np.random.default_rng(3)
    vocab = [a + b for a in ("the", "on", "Ré", "st", "ab", "xy") for b in ("", "ing", "er", "ö", "Is", "q.")]
    text = lambda n: " ".join(rng.choice(vocab, n))
    base, passage = text(120), text(55)
    near = base.split()
    near[60] = "changed"
    other = base.split()
    other[5] = "edited"
    docs = [
        base, base, " ".join(near), " ".join(other), base.upper(), None, "", " \n\t ", "one", "one two three", "One TWO three", "a\x0bb\x0cc  d\r\ne",
        f"{text(30)}\n{passage} {text(40)}", f"{passage}\n{text(25)}", f"{text(10)} {passage} {passage}", "x y " * 60, "line one here\nline one here\nother\n\n\nline one here",
        text(2500), "　wide space   x", "<|endoftext|> a", "日本語のテキスト" * 20, "é" * 5000, "ab# *$ %&|<> " * 9, "Released under the MIT License.\nplain words here",
    ]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", "de", None][i % 4], f"s{i}", 7, f"clash{i}") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, row string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def test_words_and_hashes():
    import pyarrow as pa

    texts = corpus()
    buf, offs = W.utf8(pa.array(texts))
    start, end, doc = W.spans(buf, offs)
    data = buf.tobytes()
    got = [(d, data[a:b].decode()) for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist())]
    assert got == [(d, w) for d, t in enumerate(texts) for w in words(t)]
    names: dict = {}
    for (_, w), h in zip(got, W.span_hashes(buf, start, end).tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_suffix_tree_base_and_gain(spark, docs, empty):
    tokens = {i: [*words(t, True), None] for i, t in enumerate(corpus())}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in tokens}
    count = Counter(x for i in tokens if train[i] for x in tokens[i])
    n, v = sum(count.values()), len(count)
    for r in suffix_tree.score(docs).collect():
        mine = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[r.doc_id], len(mine), sum(count[x] > 0 for x in mine), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in mine))
    assert suffix_tree.score(empty).count() == 0
    cycle = " ".join(["alpha beta gamma delta"] * 30)
    rows = spark.createDataFrame([(i, cycle) for i in range(20)], "doc_id long, text string")
    assert all(r.score > r.base_score + 10 for r in suffix_tree.score(rows).collect())


def removed_by_hand(texts, window):
    seen, out = set(), {}
    for i, t in texts:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [20, 7])
def test_substring_dedup(docs, empty, window):
    got = substring_dedup.dedup(docs, window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == removed_by_hand(enumerate(corpus()), window)
    assert all(sum(x["stop"] - x["start"] for x in r.removed) == r.n_removed for r in got)
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_property(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["a", "b"], rng.integers(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(rows, 9).collect()}
    assert got == removed_by_hand(enumerate(texts), 9)


def components_by_hand(texts):
    sets = {}
    for i, t in texts:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.join(docs).collect()}
    assert got == components_by_hand(enumerate(corpus()))
    assert near_duplicates.join(empty).count() == 0


def test_near_duplicates_at_the_edge(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(6, 90))]
        for _ in range(4):
            copy = list(base)
            for k in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[k] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy[: len(copy) - int(rng.integers(0, 4))]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.join(rows).collect()}
    assert got == components_by_hand(enumerate(texts))


def test_bands_cover_partners():
    upper = near_duplicates.bands(400)
    band = lambda m: int(np.searchsorted(upper, m))
    for m in range(1, 300):
        for s in range(m, m * 4 // 3 + 1):
            assert band(s) - band(m) in (0, 1)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 50), (100, 60), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 60: 50, 100: 50}


def test_language(spark, sf_dir, docs, empty):
    rows = queries.op3_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert got[5] == got[6] == got[7] == "und" and set(got.values()) <= {"en", "fr", "de", "und"}
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(corpus())}
    at, sequences = Counter(), {}
    for r in packing.pack(docs, JSON, 256).orderBy("doc_id", "start").collect():
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[i] == len(x) for i, x in ids.items())
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(empty, JSON).count() == 0


def test_patterns_fill_packs():
    rng = np.random.default_rng(1)
    histogram = Counter(rng.integers(1, 1024, 50_000).tolist())
    packs = packing.patterns(dict(histogram), 1024)
    got = Counter()
    for lengths, n in packs:
        assert sum(lengths) <= 1024
        for x in lengths:
            got[x] += n
    assert got == histogram
    assert sum(n for _, n in packs) * 1024 < 1.02 * sum(k * n for k, n in histogram.items())
    assert packing.patterns({100: 25}, 1024) and sum(n for _, n in packing.patterns({100: 25}, 1024)) == 3


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 4, (37, 21, 3)).astype(np.uint8), np.zeros((5, 300, 1), np.uint8), rng.integers(0, 256, (70, 90, 1)).astype(np.uint8)]
    data = tiff.write_tiff(pages, compression, predictor, tile, 8, order)
    assert all((a == b).all() for (_, a), b in zip(tiff.read_tiff(data), pages, strict=True))


def test_tiff_column(spark, docs):
    got = {r.doc_id: r for r in tiff.pages(tiff.from_texts(docs)).collect()}
    for i, t in enumerate(corpus()):
        raw = (t or "").encode()
        assert bytes(got[i].pixels) == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and got[i].error is None
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(tiff.write_tiff([np.zeros((3, 3, 1), np.uint8)] * 2)))], "doc_id long, media binary")
    rows = sorted((r.doc_id, r.page, r.error is None) for r in tiff.pages(bad).collect() if r.page is not None)
    assert rows == [(3, 0, True), (3, 1, True)] and tiff.pages(bad).where("error is not null").count() == 2


def test_payloads_meet_every_codec_predictor_and_layout_at_every_size():
    rng = np.random.default_rng(4)
    for size in (192, 960, 48_000):
        met = set()
        for _ in range(150):
            raw = rng.integers(32, 127, size).astype(np.uint8).tobytes()
            ((tags, px),) = tiff.read_tiff(tiff.payload_tiff(raw))
            assert px.tobytes() == raw
            met.add((tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tiff.TILE_OFFSETS in tags))
        assert len(met) == 12


def test_lzw_through_table_clears():
    rng = np.random.default_rng(5)
    for raw in [b"", b"a", bytes(40_000), rng.integers(0, 256, 40_000).astype(np.uint8).tobytes(), *(rng.integers(0, 3, n).astype(np.uint8).tobytes() for n in range(3_000, 60_000, 1_777))]:
        assert tiff.unlzw(tiff.lzw(raw)) == raw


def test_license_scan(spark, docs, empty):
    model = license_scan.fit(docs)
    got = {r.doc_id: r for r in license_scan.scan(docs, model).collect()}
    texts = corpus()
    assert [h.family for h in got[len(texts) - 1].hits] == ["MIT"] and sum(len(r.hits) for r in got.values()) == 1
    assert all(got[i].n_paragraphs == sum(bool(WORD.search(x)) for x in (t or "").split("\n")) for i, t in enumerate(texts))
    changed = spark.createDataFrame([(1, "As noted: licensed under the apache license, version 2.0.\nThis is licensed under nothing at all by anyone")], "doc_id long, text string")
    assert [h.family for h in license_scan.scan(changed, model).first().hits] == ["Apache-2.0"]
    assert license_scan.scan(empty, model).count() == 0


def test_license_scan_inline_wrapped_and_whole(spark, docs):
    import textwrap

    rng = np.random.default_rng(6)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "of", "the", "in", "walks", "green", "and", "to", "house"], n))
    apache = license_scan.TEMPLATES["Apache-2.0"][1]
    mit, gpl = (license_scan.bodies()[x] for x in ("MIT", "GPL-3.0"))
    texts = [
        f"{prose(400)} This project is licensed under the terms of the MIT license. {prose(300)}", f"{prose(20)}\n" + textwrap.fill(apache, 40, initial_indent=" * ", subsequent_indent=" * "), mit[0], "\n\n".join(mit), "\n\n".join(textwrap.fill(p, 70) for p in gpl),
        prose(3000), "of the " * 5000, f"{prose(9)} the software and the source code of the program",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.hits for r in license_scan.scan(rows, license_scan.fit(docs)).collect()}
    assert [[h.family for h in got[i]] for i in (0, 1, 2, 3)] == [["MIT"], ["Apache-2.0"], ["MIT"], ["MIT"] * 3]
    assert texts[0][got[0][0].start : got[0][0].stop] == "This project is licensed under the terms of the MIT license."
    assert {h.family for h in got[4]} == {"GPL-3.0"} and sum(h.stop - h.start for h in got[4]) > 0.8 * len(texts[4])
    assert [got[i] for i in (5, 6, 7)] == [[], [], []]


def test_quality(docs, empty):
    trusted = docs.where("doc_id in (0, 12, 13, 17)").select("doc_id")
    texts = corpus()
    for r in quality.judge(docs, trusted).collect():
        t = texts[r.doc_id] or ""
        w, lines, again = words(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in lines
                lines.add(line)
        tri, covered = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if tri[w[k], w[k + 1], w[k + 2]] > 1:
                covered |= {k, k + 1, k + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty, trusted).count() == 0
    assert {r.score for r in quality.judge(docs, trusted.limit(0)).collect()} == {0.0}


def test_quality_score_by_hand(docs):
    texts = [(t or "").encode() for t in corpus()]
    grams = [[int.from_bytes(t[k : k + 4], "little") * 0x9E3779B1 % 2**32 >> 16 for k in range(len(t) - 3)] for t in texts]
    raw, target = Counter(g for x in grams for g in x), Counter(g for k in (0, 12) for g in grams[k])
    b = quality.BUCKETS
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + b)) - math.log((raw[g] + 1) / (raw.total() + b))
    for r in quality.judge(docs, docs.where("doc_id in (0, 12)").select("doc_id")).collect():
        x = grams[r.doc_id]
        assert r.score == pytest.approx(sum(map(ratio, x)) / max(1, len(x)), abs=1e-9)


def test_codec(docs, empty):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe_codec.decode(bpe_codec.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect():
        t = corpus()[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids) and bytes(r.bytes) == t.encode() and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe_codec.encode(empty, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_token_counts(docs, empty, block):
    got = {r.tag: (r.n_tokens, r.ended) for r in token_counts.scan(token_counts.token_blocks(docs, RANKS, PATTERN, 50256, block), 50256).collect()}
    want = {r.doc_id: (r.n_tokens, True) for r in bpe_codec.encode(docs, RANKS, PATTERN).collect()}
    assert got == want
    assert token_counts.scan(token_counts.token_blocks(empty, RANKS, PATTERN, 50256), 50256).count() == 0


def test_flat_files(spark, tmp_path):
    a, b = np.array([1, 2, 9, 9, 3, 9, 4, 5], "<u2"), np.array([9, 1, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(a.tobytes())
    (tmp_path / "b.bin").write_bytes(b.tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    for block in (1, 2, 3, 100):
        got = token_counts.scan(token_counts.file_blocks(spark, str(tmp_path), block), 9).orderBy("file", "doc_no").collect()
        by = {}
        for r in got:
            by.setdefault(r.file, []).append((r.n_tokens, r.ended))
        assert sorted(by.values()) == [[(0, True), (1, True)], [(2, True), (0, True), (1, True), (2, False)]]


def test_pipeline(spark, sf_dir):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, left, sf_dir)
        assert after.columns == docs.columns
        rows = after.collect()
        left = spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id: r.text for r in left.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    by = components_by_hand([(i, t) for i, t in texts.items() if len(words(t)) >= 5][:120])
    assert all(i == by[i][1] for i in kept if i in by and by[i][1] in kept)
    assert not any(labels.get(i) == 0 for i in kept)
    assert {i: t for i, t in kept.items()} == {i: x[2] for i, x in removed_by_hand([(i, texts[i]) for i in sorted(kept)], 20).items()}
    packed = corpus_pipeline.STAGES[4][1](spark, left, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(kept)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_rows_without_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates.join(rows).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert substring_dedup.dedup(rows).count() == 3 and suffix_tree.score(rows).count() == 3
    assert packing.pack(rows, JSON).select(F.countDistinct("sequence_id", "offset")).first()[0] == 4
