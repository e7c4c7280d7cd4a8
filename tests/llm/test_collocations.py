"""Collocations against the oracle and plain counting; the automaton against plain substrings."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tagplane.llm import collocations as co

from .conftest import DOCS, SF, lower


def brute(rows, longest=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and within(p, q) for q, b in found.items() if set(p) <= set(q)):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}
    return out


def texts(df):
    return [(r["text"], r["lang"]) for r in df.collect()]


def test_automaton_has_all_substrings_and_merges_those_with_equal_ends():
    rng = random.Random(5)
    runs = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    symbols = np.array([x for r in runs for x in r])
    opens = np.array([i == 0 for r in runs for i in range(len(r))])
    made = co.SuffixAutomaton(symbols, opens, 4)
    places = defaultdict(set)
    for j, r in enumerate(runs):
        for a in range(len(r)):
            for b in range(a + 1, min(a + 4, len(r)) + 1):
                places[tuple(r[a:b])].add((j, b))
    state = {}
    for length, level in enumerate(made.levels, 1):
        found = list(zip(*(x.tolist() for x in made.symbols_of(length, np.arange(len(level.count)))), strict=True))
        assert set(found) == {p for p in places if len(p) == length}
        assert all(len(places[p]) == c for p, c in zip(found, level.count, strict=True))
        if length > 1:
            shorter = list(zip(*(x.tolist() for x in made.symbols_of(length - 1, level.link)), strict=True))
            assert shorter == [p[1:] for p in found]
        state |= dict(zip(found, level.state.tolist(), strict=True))
    # States are the classes of substrings that end at the same places.
    assert len(set(state.values())) == made.n_states == len({frozenset(v) for v in places.values()})
    assert all((state[p] == state[q]) == (places[p] == places[q]) for p in state for q in state)


def test_equals_oracle(spark):
    got = co.op11_suffix_collocations(spark, SF)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    ours = set(map(tuple, got.collect()))
    assert dict(got.dtypes)["rank"] == "bigint" and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert ours == set(db.execute(co.OP11_ORACLE).fetchall()) and len(ours) > 100


@pytest.mark.parametrize(("longest", "least", "percent", "size"), [(3, 2, 50, 1 << 23), (4, 3, 80, 700), (2, 1, 50, 100)])
def test_equals_plain_counting(spark, small_docs, longest, least, percent, size):
    docs = small_docs.where("doc_id < 30").repartition(3)
    assert set(map(tuple, co.collocations(docs, longest, least, percent, 50, size).collect())) == brute(texts(docs), longest, least, percent, 50)


def test_a_full_bitmap_changes_nothing(spark, small_docs, monkeypatch):
    docs = small_docs.where("doc_id < 20")
    expected = brute(texts(docs), 3, 2)
    monkeypatch.setattr(co, "MOST_BITS", 64)
    assert set(map(tuple, co.collocations(docs, 3, 2).collect())) == expected


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is null or doc_id <> 5")
    for size in (1 << 23, 16):
        assert set(map(tuple, co.collocations(docs, least=1, shard_bytes=size).collect())) == brute(texts(docs), least=1)
    assert co.collocations(no_docs).collect() == []
    rows = [(1, "a,b c\td\x0be f?g. a b", "x", "", 0), (2, "", "x", "", 0), (3, "a b\x00c  d A B.", None, "", 0), (4, "no marks " * 50, "y", "", 0), (5, None, "y", "", 0)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    assert set(map(tuple, co.collocations(docs, least=2, shard_bytes=20).collect())) == brute(texts(docs), least=2)


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**12, 2 * 10**12, 3 * 10**12)], "a long, l long, r long")
    score = F.call_function("div", co._times(F.col("a"), F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), co._times(F.col("l"), F.col("r")))
    assert df.select(score.alias("s")).first()["s"] == 10**6 // 6
