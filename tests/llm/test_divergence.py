"""The audit against its oracle and against plain counting."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tagplane.llm import divergence

from .conftest import DOCS, SF, lower


def brute(rows, least=divergence.LEAST_DOCS, top=divergence.TOP):
    by_lang = defaultdict(list)
    for text, lang, source in rows:
        by_lang[lang or ""].append((source or "", re.findall(divergence.TERM, lower(text))))
    out = set()
    for lang, docs in by_lang.items():
        in_docs = Counter(t for _, terms in docs for t in set(terms))
        kept = [t for t, n in in_docs.items() if n >= least]
        counts = {s: Counter() for s, _ in docs}
        for s, terms in docs:
            counts[s].update(terms)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def test_equals_oracle_and_plain_counting(spark, small_docs):
    got = divergence.op13_wide_terms(spark, SF)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    ours = set(map(tuple, got.collect()))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and len(ours) > 1000
    assert ours == set(db.execute(divergence.OP13_ORACLE).fetchall())
    assert ours == brute([(r["text"], r["lang"], r["source"]) for r in small_docs.collect()])


@pytest.mark.parametrize("least", [1, 2, 1000])
def test_odd_rows(spark, odd_docs, least):
    got = divergence.audit(odd_docs.withColumns({"term": F.lit(1), "cells": F.lit(2), "terms": F.lit(3)}), least)
    assert set(map(tuple, got.collect())) == brute([(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()], least)


def test_ties_sources_without_terms_and_empty_table(spark, no_docs):
    rows = [(k, "A b a 1-2 É", "x", s, 0) for k, s in enumerate("aabbc")] + [(9, "12 - 3", "x", "none", 0), (10, None, "y", "p", 0), (11, "", "y", "q", 0), (12, "b b", "x", "c", 0)]
    got = set(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS), 2, 1).collect()))
    assert got == brute([r[1:4] for r in rows], 2, 1)
    assert ("y", "p", "pair", "q", 0, 1) in got
    assert divergence.audit(no_docs).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(10**15, 3 * 10**15 + 7), (9 * 10**9 - 2, 10**10 + 1), (9 * 10**9 - 3, 9 * 10**9), (5, 13), (8 * 10**15, 9 * 10**15)]
    df = spark.createDataFrame(cases, "c long, d long").select("c", "d", divergence._share(F.col("c"), F.col("d")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // r["d"] for r in df.collect())
