"""Weak rules and the factorisation machine."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagplane.llm import quality_model as qm
from tagplane.llm import quality_rules as qr
from tagplane.llm.words import word_slices

from .conftest import SF
from .test_words import brute_form


def test_em_finds_rates():
    rng = random.Random(4)
    hits, alarms, good = [0.8, 0.6, 0.5, 0.7], [0.03, 0.02, 0.05, 0.01], 0.8
    counts = {}
    for _ in range(40_000):
        fine = rng.random() < good
        votes = tuple(0 if rng.random() < 0.1 else (-1 if rng.random() < (a if fine else h) else 1) for h, a in zip(hits, alarms, strict=True))
        counts[votes] = counts.get(votes, 0) + 1
    votes = np.array(list(counts))
    found = qr.fit(votes, np.array(list(counts.values())))
    assert found.good == pytest.approx(good, abs=0.02)
    assert found.hits == pytest.approx(hits, abs=0.04) and found.alarms == pytest.approx(alarms, abs=0.02)
    post = found.posterior(np.array([[1, 1, 1, 1], [-1, -1, -1, -1], [0, 0, 0, 0]]))
    assert post[0] > 0.95 and post[1] < 0.01 and post[2] == pytest.approx(found.good)


def test_patterns_are_votes():
    all_votes = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    codes = ((all_votes + 1) * 3 ** np.arange(3)).sum(axis=1)
    assert (qr.votes_of(codes, 3) == all_votes).all()


def test_verdict_against_plain_expectation_maximisation(spark):
    """The estimates again, text by text in plain Python, and the posterior of each text."""
    rows = qr.posteriors(qr.form_counts(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    votes = []
    for r in rows:
        one = []
        for rule in qr.RULES:
            x = float(r[rule.over]) if rule.under == "one" else r[rule.over] / max(r[rule.under], 1)
            one.append(-1 if x < rule.bad_below or x > rule.bad_above else int(rule.good_from <= x <= rule.good_to))
        votes.append(one)
    good = [0.1 if -1 in v else 0.95 for v in votes]
    last = -1.0
    for _ in range(200):
        hits, alarms = [], []
        for k in range(len(qr.RULES)):
            of = lambda weigh, what: sum(weigh(g) for g, v in zip(good, votes, strict=True) if v[k] in what)  # noqa: B023, E731
            hit = (of(lambda g: 1 - g, (-1,)) + 0.6) / (of(lambda g: 1 - g, (-1, 1)) + 2)
            hits.append(hit)
            alarms.append(min((of(lambda g: g, (-1,)) + 0.02) / (of(lambda g: g, (-1, 1)) + 2), hit / 2))
        share = min(max((sum(good) + 9) / (len(good) + 10), 0.02), 0.998)
        good = []
        for v in votes:
            fine, bad = share, 1 - share
            for x, h, a in zip(v, hits, alarms, strict=True):
                fine *= a if x == -1 else 1 - a if x == 1 else 1
                bad *= h if x == -1 else 1 - h if x == 1 else 1
            good.append(fine / (fine + bad))
        if abs(share - last) < 1e-9:
            break
        last = share
    assert all(r["posterior"] == pytest.approx(g, abs=1e-6) for r, g in zip(rows, good, strict=True))


def test_rules_query(spark, small_texts):
    got = {r["doc_id"]: r for r in qr.op2_weak_rules(spark, SF).collect()}
    assert got.keys() == small_texts.keys()
    for i, t in small_texts.items():
        n, chars, symbols, dup, rep, _ = brute_form(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [i for i in labels if i in got and not got[i]["base_failed"]]
    assert sum(got[i]["kept"] == bool(labels[i]) for i in judged) >= 0.95 * len(judged)


def test_rules_odd_rows(spark, odd_docs, no_docs):
    rows = qr.posteriors(qr.form_counts(odd_docs)).collect()
    assert len(rows) == 13 and all(0 <= r["posterior"] <= 1 for r in rows)
    assert qr.posteriors(qr.form_counts(no_docs)).count() == 0


def brute_margin(model, hashes, form):
    """The sum over all pairs of features; a bucket's value is its share of the words."""
    times = {}
    for h in hashes:
        times[h] = times.get(h, 0) + 1
    feats = [(b, t / len(hashes)) for b, t in times.items()] + [(f, 1.0) for f in form]
    want = model.bias + sum(model.linear[i] * x for i, x in feats)
    return want + sum(model.factors[i] @ model.factors[j] * a * b for (i, a), (j, b) in itertools.combinations(feats, 2))


def test_pairwise_identity():
    """The linear-time sum equals the sum over pairs, repeated words included."""
    draw = np.random.Generator(np.random.PCG64(1))
    model = qm.Model(0.3, draw.normal(0, 1, qm.SIZE), draw.normal(0, 0.3, (qm.SIZE, qm.FACTORS)))
    texts = pa.array(["One two, three two!", "", None, "THE!! END!!", "spam " * 20])
    part = next(word_slices(texts, lower=True))
    chars = np.array([18, 0, -1, 11, 100])
    form = qm.form_features(part, chars)
    bucket = (part.hashes % np.uint64(qm.WORD_BUCKETS)).astype(np.int64)
    for d, got in enumerate(model.margins(part, chars)):
        assert got == pytest.approx(brute_margin(model, bucket[part.doc == d].tolist(), form[d]), rel=1e-4, abs=1e-4)


def test_fit_and_score_use_one_formula(spark):
    """The features that the fit gets give the margins that the scorer gives, repeated words included."""
    draw = np.random.Generator(np.random.PCG64(2))
    model = qm.Model(-0.2, draw.normal(0, 1, qm.SIZE), draw.normal(0, 0.3, (qm.SIZE, qm.FACTORS)))
    texts = {1: "again " * 30, 2: "a fine text of some words, and a few words more", 3: "", 4: None}
    docs = spark.createDataFrame([(i, t, 50) for i, t in texts.items()] + [(2, texts[2], 50)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in texts], "doc_id long, quality int")
    rows = qm.training_rows(docs, labels, F.lit(False), 100).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4]
    score = {r["doc_id"]: r["_fm_score"] for r in qm.scored(docs, model).collect()}
    for r in rows:
        ids, x = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32).astype(float)
        xv = model.factors[ids] * x[:, None]
        margin = model.bias + model.linear[ids] @ x + 0.5 * ((xv.sum(axis=0) ** 2).sum() - (xv**2).sum())
        assert score[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-5)


def test_model_query(spark):
    sf = "/root/testdata/sf0.01"
    got = qm.op7_factorisation(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_model_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    model = qm.train(odd_docs, labels)
    out = qm.scored(odd_docs, model)
    assert out.columns == [*odd_docs.columns, "_fm_score"]
    assert out.where("_fm_score between 0 and 1").count() == 13
    assert qm.scored(no_docs, model).count() == 0
    one_kind = qm.train(odd_docs, labels.where("quality = 1"))
    assert qm.scored(odd_docs, one_kind).select("_fm_score").distinct().count() == 1
    without = odd_docs.drop("n_chars")
    assert qm.scored(without, model).where(F.col("_fm_score").isNotNull()).count() == 13
