"""Components of near-duplicates against all pairs."""

import random

import pytest

from tagplane.llm import near_dups

from .conftest import shingle_set


def brute(texts, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_documents(small_docs, small_texts):
    """Shingles of two words; those of five are compared as a stage of the pipeline."""
    assert got(near_dups.near_duplicates(small_docs, 2)) == brute(small_texts, 2)


def family(seed, n, edits, size=120):
    """Copies of one text with a few words changed or cut, and texts that share a long passage."""
    rng = random.Random(seed)
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        if rng.random() < 0.3:
            w = w[: rng.randint(size * 3 // 4, size)]
        out.append(" ".join(w))
    out += [" ".join([*base[:60], *(f"p{rng.randint(0, 10**6)}" for _ in range(rng.randint(15, 60)))]) for _ in range(n // 2)]
    return out


@pytest.mark.parametrize("seed,edits,block", [(1, 4, 1024), (3, 20, 16)])
def test_groups_lose_no_link(spark, monkeypatch, seed, edits, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "SHORT", 32 if block == 1024 else 3)
    texts = dict(enumerate(family(seed, 60, edits)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(near_dups.near_duplicates(docs, 2)) == brute(texts, 2)


def bridged(seed):
    """Two families; one copy of the first text has a passage that only the text of the second has too."""
    rng = random.Random(seed)
    fresh = lambda n: [f"f{rng.randint(0, 10**9)}" for _ in range(n)]
    one, two, passage = fresh(120), fresh(108), fresh(12)
    out = [one, one[:108] + passage, two + passage]
    for base, copies in ((one, 6), (two, 15)):
        for k in range(copies):
            at = 12 * (k % 8)
            out.append(base[:at] + fresh(12) + base[at + 12 :])
    return [" ".join(w) for w in out]


def test_hub_of_all_its_lists_keeps_its_links(spark):
    texts = dict(enumerate(t for seed in range(6) for t in bridged(seed)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(near_dups.near_duplicates(docs, 2)) == brute(texts, 2)


def test_one_list_of_loosely_alike_texts_makes_no_pairs(spark, monkeypatch):
    """Texts that share a long passage, none similar to another but for two planted pairs."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(70)]
    texts = {k: " ".join([*passage, *(f"q{rng.randint(0, 10**7)}" for _ in range(30))]) for k in range(1500)}
    texts[2000] = texts[3] + " x"
    texts[2001] = "y " + texts[700]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    dealt = []
    real = near_dups.dealt_blocks
    monkeypatch.setattr(near_dups, "BLOCK", 256)
    monkeypatch.setattr(near_dups, "dealt_blocks", lambda members: (dealt.append(real(members).count()), real(members))[1])
    found = {i: c for i, (_, c, _) in got(near_dups.near_duplicates(docs, 2)).items()}
    assert found == {**{k: k for k in texts}, 2000: 3, 2001: 700}
    assert sum(dealt) < 40 * len(texts)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_dups.near_duplicates(odd_docs, 5).collect()
    assert len(rows) == 13
    by = {(r["doc_id"], r["component_id"]) for r in rows}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (10, 4), (6, 6), (7, 6), (8, 6), (None, 6), (None, None)} <= by
    assert [r["kept"] for r in rows if r["doc_id"] is None and r["component_id"] is None] == [True]
    left = near_dups.stage(spark, odd_docs, "")
    assert left.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 6, 9]
    assert near_dups.near_duplicates(no_docs, 5).count() == 0


def test_long_texts_make_more_blocks(spark, monkeypatch):
    """Blocks are bounded by shingles too, and what they find does not depend on it."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 900)}" for _ in range(300)]
    texts = {i: " ".join([*base[:100], *(f"x{i}n{k}" for k in range(i % 40)), *base[100:]]) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members = spark.createDataFrame([(i, 1, i, i, 300) for i in texts], "rep long, group long, part long, home long, n_shingles long")
    found = []
    for bound in (10**9, 3000):
        monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", bound)
        found.append((near_dups.dealt_blocks(members).select("i", "j").distinct().count(), {tuple(r) for r in near_dups.block_links(members, docs, 2, 80).collect()}))
    (one, links), (many, same) = found
    assert one == 1 and many > 20
    assert {tuple(sorted(p)) for p in links} == {tuple(sorted(p)) for p in same} and len(links) > 100
