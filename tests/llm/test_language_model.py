"""Elias-Fano levels, the trie, and scores against a plain model in Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagplane.llm import language_model as lm
from tagplane.llm.elias_fano import EliasFano, Trie, dequantise, quantise

from .conftest import lower, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**45), min_size=1, max_size=300))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    built = EliasFano.build(values)
    again, _ = EliasFano.read(memoryview(built.to_bytes()), 0)
    n = len(values)
    assert (again.values() == values).all()
    assert (again.access(np.arange(n)) == values).all()
    x = np.array([0, values[0], values[-1], values[-1] + np.uint64(1), values[n // 2]], np.uint64)
    assert (again.successors(x, np.zeros(5), np.full(5, n)) == np.searchsorted(values, x)).all()
    assert (again.successors(x, np.full(5, n // 2), np.full(5, n)) == n // 2 + np.searchsorted(values[n // 2 :], x)).all()


def test_quantised_shares():
    shares = np.array([1.0, 0.5, 1e-6, 3e-13, 0.0])
    assert dequantise(quantise(shares)) == pytest.approx(shares, rel=3e-4)


def test_trie_finds_children_and_is_compact():
    rng = random.Random(1)
    grams = sorted({(rng.randint(1, 300), rng.randint(1, 2000), rng.randint(1, 2**30)) for _ in range(30_000)})
    u, v, w = (np.array(x, np.int64) for x in zip(*grams, strict=True))
    first, of_u = np.unique(u, return_inverse=True)
    pf, second, pair = lm.distinct_pairs(of_u, v)
    times = np.array([rng.randint(0, 3) for _ in grams])
    blob = lm.train_trie(first, np.full(len(first), 1000), pf, second, pair, w, times)
    trie = Trie.mapped(blob)
    kept = sum(t > 0 for t in times)
    assert len(blob) < 13 * kept  # two levels of 24 bytes of plain ids and 4 of codes otherwise
    one, two, three = trie.levels
    a = one.find(np.zeros(len(first), np.int64), first)
    assert (a == np.arange(len(first))).all()
    b = two.find(a[pf], second)
    c = three.find(b[pair], w)
    assert ((c >= 0) == (times > 0)).all()
    n_pair = np.bincount(pair, times, len(second))
    assert dequantise(three.codes[c[c >= 0]]) == pytest.approx((times / (n_pair[pair] + lm.A3))[times > 0], rel=3e-4)
    assert ((b >= 0) == (n_pair > 0)).all()
    assert one.find(np.zeros(2, np.int64), np.array([0, 10**9])).tolist() == [-1, -1]
    assert three.find(np.array([-1, int(b.max())]), np.array([int(w[0]), 2**40])).tolist() == [-1, -1]


def test_pack_round_trip():
    for x in ([], [0], [1, 2**40, 7], list(range(300))):
        assert lm.unpack(lm.pack(np.array(x, np.uint64))).tolist() == x


def brute(texts, held):
    tokens = {i: [*words(lower(t)), None] for i, t in texts.items()}
    uni = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(uni.values()), len(uni)
    pairs, triples, after1, after2 = Counter(), Counter(), Counter(), Counter()
    for i in tokens:
        if not held[i]:
            ws = ["<s>", "<s>", *tokens[i]]
            for a, b, w in zip(ws, ws[1:], ws[2:], strict=False):
                pairs[b, w] += 1
                after1[b] += 1
                triples[a, b, w] += 1
                after2[a, b] += 1
    out = {}
    for i, ws in tokens.items():
        low = [(uni[w] + 1) / (n + v + 1) for w in ws]
        full = 0.0
        before = ["<s>", "<s>", *ws]
        for a, b, w, p in zip(before, before[1:], ws, low, strict=False):
            p = (pairs[b, w] + lm.A2 * p) / (after1[b] + lm.A2)
            full += math.log10((triples[a, b, w] + lm.A3 * p) / (after2[a, b] + lm.A3))
        out[i] = (held[i], len(ws), sum(uni[w] > 0 for w in ws), n, sum(map(math.log10, low)), full)
    return out


def test_scores_do_not_depend_on_shards(spark, small_docs, small_texts, monkeypatch):
    """One shard and many, with first words dealt out, against a plain model."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in small_texts}
    want = brute(small_texts, held)
    rule = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    for entries, words_each in ((2_000_000, 600_000), (6_000, 20_000)):
        monkeypatch.setattr(lm, "SHARD_ENTRIES", entries)
        monkeypatch.setattr(lm, "BUNDLE_WORDS", words_each)
        got = {r["doc_id"]: tuple(r)[1:] for r in lm.score_texts(small_docs, rule).collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert got[i][:4] == w[:4]
            assert got[i][4] == pytest.approx(w[4], rel=1e-9)
            assert got[i][5] == pytest.approx(w[5], rel=1e-5)
        if entries == 2_000_000:
            whole = got
    assert all(got[i][5] == pytest.approx(whole[i][5], rel=1e-9) for i in got)
    unseen = [i for i in want if held[i]]
    assert sum(got[i][5] for i in unseen) > sum(got[i][4] for i in unseen)


def test_model_sums_to_one(spark):
    """The scores of all texts of one word, and of the empty one, with all that can follow, make a distribution."""
    train = [(k, t) for k, t in enumerate(["a b", "a a b", "b", "c a", ""] * 3)]
    probes = [(100 + k, t) for k, t in enumerate(["", "a", "b", "c", "unseen"])]
    docs = spark.createDataFrame(train + probes, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("doc_id") >= 100).collect()}
    want = brute(dict(train + probes), {i: i >= 100 for i, _ in train + probes})
    assert all(got[i] == pytest.approx(want[i][5], rel=1e-4) for i in got)


def test_odd_rows(spark, odd_docs, no_docs):
    got = lm.score_texts(odd_docs, F.col("doc_id") == 8).collect()
    assert len(got) == 13
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_texts(no_docs, F.lit(False)).count() == 0
