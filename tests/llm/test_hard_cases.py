"""Deep trees, tiny chunks, long runs, broken files, awkward rows, and results that outlive other calls."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe_codec, exchange, near_duplicates, quality, substring_dedup, suffix_tree, tiff, token_counts, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Chunks and groups so small that keys go by way of batches of chunks.
SMALL = {"size": 2000, "group": 4000, "fan": 2}


def corpus():
    rng = np.random.default_rng(3)
    vocab = [a + b for a in ("the", "on", "Ré", "st") for b in ("", "ing", "er", "q.")]
    text = lambda n: " ".join(rng.choice(vocab, n))
    base = text(120)
    return [base, base.upper(), None, "", " \n", "one", "one two three", text(500), f"{text(9)} {base}", "x y " * 60, text(40)] * 3


def scores_by_hand(texts, depth):
    """(log10 probabilities, states, probability of a word after a context, words) from counts of all sequences."""
    toks = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts}
    count = Counter(tuple(x[a - k : a + 1]) for i, x in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for a in range(len(x)) for k in range(min(a, depth) + 1))
    single = {g[0]: c for g, c in count.items() if len(g) == 1}
    total, follow, kept = sum(single.values()), {}, {}
    for g, c in count.items():
        if len(g) > 1 and c >= 2:
            follow.setdefault(g[:-1], {})[g[-1]] = c
    for s, f in follow.items():
        n, rest = count[s], count[s] - sum(f.values())
        low = {x: count[(*s[1:], x)] / (count[s[1:]] if len(s) > 1 else total) for x in f}
        tail = rest * math.log(rest / n / max(1 - sum(low.values()), 1e-12)) if rest else 0
        if sum(c * math.log(c / (n * low[x])) for x, c in f.items()) + tail >= max(suffix_tree.DIVERGENCE * n, suffix_tree.EVIDENCE):
            kept[s] = sum(f.values())

    def p(context, x):
        if not context:
            return (count[(x,)] + 1) / (total + len(single) + 1)
        below, n = p(context[1:], x), count[context]
        return (follow[context].get(x, 0) + (n - kept[context] + suffix_tree.PRIOR) * below) / (n + suffix_tree.PRIOR) if context in kept else below

    return {i: sum(math.log10(p(tuple(x[max(0, a - depth) : a]), x[a])) for a in range(len(x))) for i, x in toks.items()}, kept, p, list(single)


@pytest.mark.parametrize(("depth", "small"), [(1, {}), (3, SMALL), (4, {})])
def test_suffix_tree(spark, depth, small):
    texts = list(enumerate(corpus()))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want, kept, p, vocabulary = scores_by_hand(texts, depth)
    assert max(map(len, kept)) == depth
    for s in list(kept)[:20]:  # a distribution, but for what one unseen word has
        assert sum(p(s, x) for x in vocabulary) <= 1 + 1e-9
    got = {r.doc_id: r.score for r in suffix_tree.score(rows, depth, **small).collect()}
    assert got == {i: pytest.approx(x, rel=1e-6) for i, x in want.items()}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corvane_")]


def test_arrays_as_bytes():
    rng = np.random.default_rng(0)
    for a in [np.diff(np.sort(rng.integers(0, 2**42, 100_000, dtype=np.uint64))), rng.integers(0, 3, 1000), np.zeros(0, np.int64), rng.integers(-5, 5, 100), np.array([True, False] * 9), (rng.random(1000) > 0.8) * rng.random(1000), rng.integers(0, 1 << 23, 1000), np.array([2**63], np.uint64)]:
        (b,) = exchange.load(exchange.dump([a]))
        assert (b == a).all() and b.dtype == a.dtype


def test_near_duplicates_in_tiny_chunks(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(20):
        base = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(6, 120))]
        for _ in range(4):
            copy = list(base)
            for k in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[k] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy[: len(copy) - int(rng.integers(0, 4))]))
    texts += texts[::7]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_duplicates.join(rows, **SMALL).collect()} == dict(enumerate(label))


def test_long_runs(spark, monkeypatch):
    enc, _ = tokens.rank_encoding(RANKS, PATTERN)
    for c in (" ", "\n", "a"):
        for t in (c * 2_000_000, f"word {c * 1_000_000} word"):
            assert enc.decode_bytes(tokens.encode_text(enc, t).tolist()) == t.encode()
    rows = spark.createDataFrame([(1, "x" + " " * 1_500_000 + "y"), (None, " " * 10), (2, None), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe_codec.decode(bpe_codec.encode(rows, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert bytes(got[1].bytes) == b"x" + b" " * 1_500_000 + b"y" and got[2].n_tokens == 0 and bytes(got[None].bytes) == b" " * 10
    counts = Counter((r.tag, r.n_tokens) for r in token_counts.scan(token_counts.token_blocks(rows, RANKS, PATTERN, 50256), 50256).collect())
    assert counts == {(1, got[1].n_tokens): 1, (None, got[None].n_tokens): 1, (2, 0): 2}
    monkeypatch.setattr(tokens, "LONG_RUN", 3)  # the rule for runs, held against the library where it can do them
    monkeypatch.setattr(tokens, "_RUN", re.compile(f"[{tokens.WHITE}]{{3,}}"))
    rng = np.random.default_rng(1)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "b1", "é", " ", "  ", "\n", "\t", "     ", "　", "\x85", "'s", "-", "日"], rng.integers(0, 30)))
        assert tokens.encode_text(enc, t).tolist() == enc.encode_ordinary(t)


def test_ids_that_no_rank_file_has(spark):
    rows = spark.createDataFrame([(1, [0, 1], 2), (2, [99_999_999], 1), (3, [-1], 1), (4, None, 0)], "doc_id long, ids array<long>, n_tokens long")
    got = {r.doc_id: r.bytes for r in bpe_codec.decode(rows, RANKS, PATTERN).collect()}
    assert got[1] and got[2] is None and got[3] is None and bytes(got[4]) == b""
    with pytest.raises(ValueError):
        token_counts.id_width(RANKS, PATTERN, 7)


def test_broken_tiffs_give_errors():
    rng = np.random.default_rng(0)
    for compression, tile in ((tiff.LZW, 16), (tiff.PACKBITS, 0), (tiff.DEFLATE, 16)):
        base = tiff.write_tiff([rng.integers(0, 255, (20, 30, 3)).astype(np.uint8)] * 2, compression, 2, tile)
        for k in range(300):
            data = bytearray(base)
            for _ in range(rng.integers(1, 6)):
                data[rng.integers(0, len(data))] = rng.integers(0, 256)
            try:
                list(tiff.read_tiff(bytes(data[: rng.integers(0, len(data))] if k % 3 == 0 else data)))
            except (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error):
                pass
    page = tiff.write_tiff([np.ones((9, 9, 1), np.uint8)], tiff.NONE, 1, 0, 4)
    at = page.index(struct.pack("<HHI", tiff.ROWS_PER_STRIP, 4, 1))
    for rows in (0, 2):  # no rows in a strip; more strips than there are
        with pytest.raises(ValueError):
            list(tiff.read_tiff(page[: at + 8] + struct.pack("<I", rows) + page[at + 12 :]))


def test_quality_keeps_what_reaches_the_threshold(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(corpus()) if t is not None] + [(None, None)], "doc_id long, text string")
    judged = quality.judge(rows, rows.where("doc_id < 5").select("doc_id")).collect()
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in judged)
    edge = max(r.score for r in judged if not r.base_failed)
    assert any(r.kept and r.score == edge for r in quality.judge(rows, rows.where("doc_id < 5").select("doc_id"), edge).collect())


def test_pipeline_stages_on_awkward_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    long = docs.orderBy(F.desc("n_chars")).first()
    odd = [(None, long.text, "en", "s", 1), (None, None, None, None, None), (7_000_001, None, None, None, None), (7_000_002, "", "en", "s", 0), (long.doc_id, long.text, "zz", "a", 1)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns
        got = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "near_duplicates":
            assert got[None] == 2 and got[7_000_001] == got[7_000_002] == 1 and max(n for i, n in got.items() if i is not None) == 1
        if name == "passages":
            assert got[None] == 2 and got[long.doc_id] == 2 and {r.text for r in out.where("doc_id in (7000001, 7000002)").collect()} == {None, ""}
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, rows, sf_dir).where("doc_id is null").count() >= 2


def test_results_outlive_other_calls(spark):
    rows = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    kept = substring_dedup.dedup(rows)  # not written yet
    near_duplicates.join(rows).count()
    substring_dedup.dedup(rows, 9).count()
    assert kept.count() == len(corpus())


def test_a_worker_gives_back_what_a_task_held(monkeypatch):
    # After the end of a function of batches its arrays are gone; slices of a batch are of 2 MB at most.
    import weakref

    import numpy as np
    import pyarrow as pa

    from corvane.llm import words

    held, alive = [], []
    monkeypatch.setattr(words, "tidy", lambda: alive.append([r() is not None for r in held]))

    def run(batches):
        for b in (part for batch in batches for part in words.parts(batch)):
            large = np.ones(1000)
            held.append(weakref.ref(large))
            yield b

    batch = pa.record_batch({"text": ["x" * 1_000_000] * 7})
    assert [b.num_rows for b in words.tidied(run)([batch])] == [2, 2, 2, 1]
    assert len(alive) == 5 and alive[-1] == [False] * 4


def test_packing_leaves_no_tokenizer_in_a_worker(spark):
    # Tasks of one core follow each other in the same worker.
    from corvane.llm import packing

    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")

    def kept(batches):
        import pyarrow as pa

        n = sum(b.num_rows for b in batches)
        yield pa.record_batch({"n": [n], "cached": [tokens.bpe_pieces.cache_info().currsize]})

    for _ in range(4):
        packing.cut(docs, path).collect()
        assert docs.mapInArrow(kept, "n long, cached long").first().cached == 0


@pytest.mark.parametrize("block", [3, 512])
def test_closing_pairs_come_once_for_a_leader(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    label = {b: b % 3 if b < 12 else b for b in range(20)}
    members = [(100, 4, b, x) for b, x in label.items()] + [(101, 5, b, 7) for b in label] + [(102, 4, b, b) for b in (1, 2)]
    words = {b: 1 << 20 if b != 19 else (1 << 40) - 1 for b in label}  # the last one is unlike all others
    some = [(b, 60, 4, [w] + [0] * 15, [w] + [0] * 31) for b, w in words.items()]
    members = spark.createDataFrame(members, "a long, name int, b long, label long")
    some = spark.createDataFrame(some, "doc_id long, n_shingles long, band int, sketch_0 array<long>, sketch_1 array<long>")
    pairs = near_duplicates._closing(members, some)
    want = sorted((a, b) for a in label for b in label if a < b < 19 and label[a] != label[b])
    assert sorted(map(tuple, pairs.collect())) == want
