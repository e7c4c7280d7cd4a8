"""Counts by running sums where regions lie thick, and in blocks so small that every pair of blocks is met."""

import random

import numpy as np
import pytest

from tagplane.functions.blocks import count_both, count_ends
from tagplane.operators.counting import _points, count_margins, count_regions
from tagplane.plans import registry
from tagplane.schema import PETS

REGIONS = "region_id long, chr string, start int, end int"
FILES = ("x", "y")


def _made(seed, n_pets, n_regions, length):
    rng = random.Random(seed)
    place = lambda: rng.randint(0, length) * rng.choice((1, -1))
    pets = [(rng.choice(FILES), rng.choice(("a", "b")), rng.choice(("a", "b")), place(), place()) for _ in range(n_pets)]
    regions = [(k, rng.choice(("a", "b")), s, s + rng.choice((0, 3, 20, 90))) for k in rng.sample(range(1, 5 * n_regions), n_regions) for s in (rng.randint(-5, length),)]
    return pets, regions


def _hits(pets, regions, ext):
    """For each pair of tags the regions under either end."""
    chrom, lo, hi = np.array([r[1] for r in regions]), np.array([r[2] for r in regions]), np.array([r[3] for r in regions])
    out = []
    for _, a, t, p, q in pets:
        ends = []
        for c, x in ((a, p), (t, q)):
            s = x - ext + 1 if x > 0 else -x
            e = s + ext - 1
            ends.append((chrom == c) & (max(s, 1) <= hi) & (lo <= e) & (e >= max(s, 1)))
        out.append(ends)
    return out


@pytest.mark.parametrize("ext,size", [(1, 3), (15, 4), (0, 5), (40, 1024)])
def test_small_blocks_equal_each_pair_by_itself(spark, ext, size):
    pets, regions = _made(ext * 7 + size, 150, 25, 120)
    ids = np.array([r[0] for r in regions])
    both = {f: np.zeros((25, 25), int) for f in FILES}
    ends = {f: np.zeros(25, int) for f in FILES}
    for pet, (x, y) in zip(pets, _hits(pets, regions, ext), strict=True):
        met = np.outer(x, y)
        both[pet[0]] += met | met.T
        ends[pet[0]] += x | y if pet[1] == pet[2] else x.astype(int) + y
    want = {(max(ids[i], ids[j]), min(ids[i], ids[j]), both["x"][i, j], both["y"][i, j]) for i in range(25) for j in range(25) if both["x"][i, j] + both["y"][i, j] >= 2}
    table = spark.createDataFrame(regions, REGIONS)
    points = _points(spark.createDataFrame(pets, PETS), FILES, ext, None)
    got = count_both(points, table, FILES, ext, 2, size).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    margins = count_margins(spark.createDataFrame(pets, PETS), table, FILES, ext).collect()
    assert {tuple(r) for r in margins} == {(ids[i], ends["x"][i], ends["y"][i]) for i in range(25)}


def test_regions_that_all_overlap(spark):
    """700 regions at one place: by hits, 4000 pairs of tags would make 2 billion rows."""
    pets = spark.range(4000).selectExpr("if(id % 3 = 0, 'x', 'y') as file", "'a' as anchor_chr", "'b' as target_chr", "cast(1000 + id % 50 as int) as anchor_pos", "cast(1000 + id % 40 as int) as target_pos")
    regions = spark.range(1400).selectExpr("id + 1 as region_id", "if(id < 700, 'a', 'b') as chr", "cast(500 + id % 300 as int) as start", "cast(1100 + id as int) as end")
    got = count_regions(pets, regions, FILES, 1, 4000).selectExpr("count(*) as n", "min(x) as x", "max(y) as y", "min(anchor_id - 700) as a", "max(target_id) as t").first()
    assert tuple(got) == (700 * 700, 1334, 2666, 1, 700)


def test_libraries_need_no_counts(spark):
    """What is asked of the libraries alone does not count pairs of regions."""
    sf = "/root/testdata/sf0.001"
    for name in ("count_list", "compress_totals", "paired_design", "one_way_design"):
        assert "MapInArrow" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not [k for k in registry.fx._stored if "region_counts" in k]


def test_ends_without_regions_near(spark):
    points = spark.createDataFrame([(0, "a", 5, 2)], "kind int, chr string, u long, times long")
    none = spark.createDataFrame([], "kind int, chr string, u long, v long")
    regions = spark.createDataFrame([(1, "a", 6, 9), (2, "b", 1, 9), (3, "a", 1, 5)], REGIONS)
    assert {tuple(r) for r in count_ends(points, none, regions, ("x",), 1).collect()} == {(1, 0), (2, 0), (3, 2)}


def test_tags_are_counted_by_place_before_the_join(spark):
    """As many rows as places go into the overlap join, however many tags lie there."""
    plan = registry.QUERIES["overlap_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :]
    assert "AS times" in below and "Aggregate" in below[: below.index("AS times")]
