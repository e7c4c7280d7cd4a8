"""Blocks and counts where very many regions lie over the same bases."""

import random

import numpy as np
import pytest

from tagplane.functions import blocks as bl

REGIONS = "region_id long, chr string, start int, end int"


def test_a_point_goes_to_few_blocks_however_many_regions(spark):
    """30,000 narrow regions on 9000 bases: blocks of 1024 regions each, some 12 over a base, would be dealt 144 times."""
    regions = spark.range(30_000).selectExpr("id + 1 as region_id", "'a' as chr", "cast((id * 373) % 9000 as int) as start", "cast((id * 373) % 9000 + 20 + (id * 97) % 1480 as int) as end")
    spans = [(r.lo, r.hi, len(r.members) // 3) for r in bl.blocks(regions, 1).collect()]
    assert sum(n for *_, n in spans) == 30_000
    assert max(sum(lo <= x <= hi for lo, hi, _ in spans) for x in range(0, 11_000, 100)) <= 3
    # Where regions lie thin, they are together as before.
    thin = spark.range(3000).selectExpr("id + 1 as region_id", "'a' as chr", "cast(id * 5000 as int) as start", "cast(id * 5000 + 90 as int) as end")
    assert bl.blocks(thin, 1).count() <= 3


@pytest.mark.parametrize("size", [2, 40, 1024])
def test_wide_and_narrow_regions_equal_each_pair_by_itself(spark, size):
    rng = random.Random(size)
    regions = [(k, rng.choice("ab"), s, s + rng.choice((0, 30, 2500, 70_000))) for k in rng.sample(range(900), 60) for s in (rng.randint(-99, 9000),)]
    points = [(rng.randrange(2), rng.choice("ab"), rng.choice("ab"), rng.randint(0, 9500), rng.randint(0, 9500)) for _ in range(400)]
    want = {}
    for x, (i, ci, si, ei) in enumerate(regions):
        for j, cj, sj, ej in regions[: x + 1]:
            met = [k for k, a, t, u, v in points if (a == ci and si <= u <= ei and t == cj and sj <= v <= ej) or (a == cj and sj <= u <= ej and t == ci and si <= v <= ei)]
            if len(met) >= 3:
                want[max(i, j), min(i, j)] = (met.count(0), met.count(1))
    table = spark.createDataFrame(regions, REGIONS)
    got = bl.count_both(spark.createDataFrame(points, "kind int, anchor_chr string, target_chr string, u long, v long").repartition(3), table, ("x", "y"), 1, 3, size).collect()
    assert len(got) == len(want) and {tuple(r[:2]): tuple(r[2:]) for r in got} == want


@pytest.mark.parametrize("same", [False, True])
def test_tables_of_some_rows_at_a_time(monkeypatch, same):
    """Regions in many slices, pairs in many runs and cells gathered again and again."""
    monkeypatch.setattr(bl, "MOST_CELLS", 1)
    monkeypatch.setattr(bl, "LEAST_ROWS", 9)
    monkeypatch.setattr(bl, "PAIRS", 50)
    rng = np.random.default_rng(3)

    def block(n, begin):
        lo = np.sort(rng.integers(begin, begin + 60, n))
        return [np.arange(n) + 1000 * begin, lo, lo + rng.integers(0, 40, n)]

    mine, theirs = block(37, 5), block(23, 30)
    met, points = bl.RegionPairs(mine, theirs, same, False), {k: rng.integers(0, 140, (2, 500)) for k in (0, 2)}
    assert len(list(met.slices())) > 3
    for k, (u, v) in points.items():
        for part in np.array_split(np.arange(500), 4):
            met.add(k, u[part], v[part])
            for cells in (met.grids[k], *([met.both[k]] if same else [])):
                cells.gather()
    inside = lambda x, r: (x >= r[1][:, None]) & (x <= r[2][:, None])
    want = {}
    for k, (u, v) in points.items():
        hit = inside(u, mine)[:, None] & inside(v, theirs)[None]
        want[k] = (hit | (inside(v, mine)[:, None] & inside(u, theirs)[None]) if same else hit).sum(axis=2)
    got = {k: np.zeros((37, 23), dtype=int) for k in points}
    for s, keep, found in met.counts(4):
        for k in points:
            got[k][s : s + len(keep)] = np.where(keep, found[k], 0)
    kept = sum(want.values()) >= 4
    assert kept.any() and all((got[k] == np.where(kept, want[k], 0)).all() for k in points)
