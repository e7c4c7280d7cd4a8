"""Counting against dense painting and per-pair recomputation, over the published parameter grids."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tagplane.functions.intervals import Grid
from tagplane.operators.counting import count_margins, count_regions, count_windows
from tagplane.schema import PETS

LENGTHS = {"chrA": 500, "chrB": 300}
FILES = ("x", "y")


def make_pets(rng, n):
    rows = []
    for f in FILES:
        for a, t in (("chrA", "chrA"), ("chrB", "chrA"), ("chrB", "chrB")):
            for _ in range(n):
                p, q = rng.randint(1, LENGTHS[a]), rng.randint(1, LENGTHS[t])
                if a == t:
                    p, q = max(p, q), min(p, q)
                rows.append((f, a, t, p * rng.choice((1, -1)), q * rng.choice((1, -1))))
    return rows


def windows(grid):
    out, k = [], 0
    for c in sorted(LENGTHS):
        length = LENGTHS[c]
        centres = []
        x = 1 if grid.right >= 0 else 1 + grid.step
        while x - grid.left <= length:
            centres.append(x)
            x += grid.step
        for x in centres:
            k += 1
            out.append((k, c, x - grid.left, x + grid.right))
    return out


def span(p, ext):
    return (p - ext + 1, p) if p > 0 else (-p, -p + ext - 1)


def dense(rows, grid, ext, least):
    wins = windows(grid)
    cells = Counter()
    for f, a, t, p, q in rows:
        (s1, e1), (s2, e2) = span(p, ext), span(q, ext)
        ah = [k for k, c, lo, hi in wins if c == a and s1 <= hi and lo <= e1]
        th = [k for k, c, lo, hi in wins if c == t and s2 <= hi and lo <= e2]
        for pair in {(max(i, j), min(i, j)) for i in ah for j in th}:
            cells[pair, f] += 1
    totals = Counter()
    for (pair, _), n in cells.items():
        totals[pair] += n
    return {(*pair, *(cells[pair, f] for f in FILES)) for pair, n in totals.items() if n >= max(1, least)}


GRID = [(10, 20, 29, 50, 5), (20, 0, 49, 50, 3), (23, 12, 7, 20, 2), (31, 10, -5, 53, 1), (41, 42, 0, 43, 2), (51, 5, 58, 40, 10), (55, 9, -9, 10, 1), (21, 9, -35, 45, 1)]


@pytest.mark.parametrize("ext,left,right,spacing,least", [g for g in GRID if g[1] + g[2] + 1 > 0])
def test_windows_match_dense(spark, ext, left, right, spacing, least):
    rows = make_pets(random.Random(ext * 31 + spacing), 40)
    grid = Grid(left + right + 1, spacing, left)
    lengths = spark.createDataFrame(list(LENGTHS.items()), "chr string, length int")
    got = {tuple(r) for r in count_windows(spark.createDataFrame(rows, PETS), lengths, FILES, grid, ext, least).collect()}
    assert got == dense(rows, grid, ext, least)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), ext=st.sampled_from([1, 10, 30, 100]), least=st.sampled_from([1, 5]))
def test_regions_and_margins_match_per_pair(spark, seed, ext, least):
    rng = random.Random(seed)
    rows = make_pets(rng, 60)
    regions = []
    for c, length in LENGTHS.items():
        for _ in range(15):
            s = rng.randint(1, length)
            regions.append((c, s, s + rng.randint(9, 60)))
    regions = [(i + 1, *r, i) for i, r in enumerate(sorted(regions))]
    pairs, margins = Counter(), Counter()
    for f, a, t, p, q in rows:
        hit = lambda chrom, x: {r[0] for r in regions if r[1] == chrom and max(1, span(x, ext)[0]) <= r[3] and r[2] <= span(x, ext)[1]}
        ah, th = hit(a, p), hit(t, q)
        for pair in {(max(i, j), min(i, j)) for i in ah for j in th}:
            pairs[pair, f] += 1
        for r in ah | th if a == t else [*ah, *th]:
            margins[r, f] += 1
    pets = spark.createDataFrame(rows, PETS)
    table = spark.createDataFrame(regions, "region_id long, chr string, start int, end int, original long")
    totals = Counter()
    for (pair, _), n in pairs.items():
        totals[pair] += n
    want = {(*pair, *(pairs[pair, f] for f in FILES)) for pair, n in totals.items() if n >= least}
    assert {tuple(r) for r in count_regions(pets, table, FILES, ext, least).collect()} == want
    assert {tuple(r) for r in count_margins(pets, table, FILES, ext).collect()} == {(r[0], *(margins[r[0], f] for f in FILES)) for r in regions}


def test_bad_parameters(spark):
    for bad in ({"width": 0}, {"width": 5, "spacing": 0}, {"width": 5, "shift": 5}, {"width": 5, "shift": -1}):
        with pytest.raises(ValueError):
            Grid(**bad)
    pets = spark.createDataFrame([], PETS)
    lengths = spark.createDataFrame(list(LENGTHS.items()), "chr string, length int")
    with pytest.raises(ValueError):
        count_windows(pets, lengths, ())
    with pytest.raises(ValueError):
        count_windows(pets, lengths, FILES, ext=-1)
    assert count_windows(pets, lengths, FILES).count() == 0
