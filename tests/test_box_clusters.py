"""Clusters of boxes by components within tiles against every two boxes compared."""

import os
import random

import numpy as np
import pytest

from tagplane.operators import clusters

BOXES = "box_id long, anchor_chr string, target_chr string, start_a long, end_a long, start_t long, end_t long"


def least_reachable(rows, tol):
    near = lambda p, q: None not in p[1:3] and p[1:3] == q[1:3] and all(p[i] < q[i + 1] + tol and q[i] < p[i + 1] + tol for i in (3, 5))
    group = {r[0]: r[0] for r in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, p in enumerate(rows):
        for q in rows[:k]:
            if near(p, q):
                a, b = find(p[0]), find(q[0])
                group[max(a, b)] = min(a, b)
    return {x: find(x) for x in group}


def random_boxes(seed, n, sides, span, chromosomes="ab"):
    rng = random.Random(seed)
    rows = []
    for k in rng.sample(range(10 * n), n):
        x, y = (rng.choice((rng.randint(-500, span), 2048 * rng.randint(0, span // 2048), 4096)) for _ in "at")
        rows.append((k, rng.choice(chromosomes), rng.choice("cd"), x, x + rng.choice(sides), y, y + rng.choice(sides)))
    return rows


@pytest.mark.parametrize("held", [1, 60, 100_000])
@pytest.mark.parametrize(("seed", "n", "sides", "span"), [(1, 300, (1, 40, 300, 5000, 70_000), 30_000), (2, 400, (1, 9, 60, 250), 9000), (3, 250, (4046, 4047, 4000, 30), 50_000)])
def test_clusters_equal_every_two_boxes(spark, held, seed, n, sides, span):
    """Boxes of several levels, on borders of tiles, before the first base, at one place; tiles in pieces of any size."""
    rows = random_boxes(seed, n, sides, span)
    got = clusters.cluster_boxes(spark.createDataFrame(rows, BOXES).repartition(3), 50, held)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == n and dict(found) == least_reachable(rows, 50)


def test_groups_that_just_miss_each_other():
    """Two crowds around points of their own: corners between them meet in one pair, or in none."""
    rng = random.Random(4)
    for gap in (0, 1):
        # Boxes of one size class that end on a falling stair, and such that begin on one a step above.
        low = [(100 - k, 128 + k, 100 - k, 255 - k) for k in rng.sample(range(100), 90)]
        high = [(128 + k + gap, 384 + k, 255 - k, 400) for k in rng.sample(range(100), 90)]
        n = len(low) + len(high)
        rows = np.zeros((12, n), dtype=np.int64)
        rows[0], rows[1:5], rows[5], rows[6], rows[11] = np.arange(n), np.array(low + high).T, 11, 11, 1
        boxes = [(k, "a", "a", *map(int, r)) for k, r in enumerate(rows[1:5].T)]
        out = clusters._components_in_tiles(rows, 11, ["a"])[1]
        names = dict(zip(out[0]["box_id"].to_pylist(), out[0]["name"].to_pylist(), strict=True))
        assert names == least_reachable(boxes, 0)


def test_unknown_chromosomes_and_no_boxes(spark):
    rows = [(5, None, "c", 0, 10, 0, 10), (4, None, "c", 0, 10, 0, 10), (3, "a", None, 0, 10, 0, 10), (2, "a", "c", 0, 10, 0, 10), (1, "a", "c", 5, 10, 5, 10)]
    got = clusters.cluster_boxes(spark.createDataFrame(rows, BOXES).coalesce(1), 5)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert clusters.cluster_boxes(spark.createDataFrame([], BOXES), 5).count() == 0


@pytest.mark.parametrize("held", [1, 100_000])
def test_boxes_given_again(spark, held):
    """One row for each box, wherever its copies are."""
    rows = random_boxes(8, 200, (1, 40, 5000), 20_000)
    got = clusters.cluster_boxes(spark.createDataFrame(rows * 4, BOXES).repartition(5), 50, held)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 200 and dict(found) == least_reachable(rows, 50)


def stored_bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_little_is_stored_for_a_box(spark):
    """Stored are names of boxes and links of names, no pairs of boxes or of groups."""
    rng = random.Random(6)
    rows = []
    for k in range(6000):
        x, y = rng.randint(1, 12_000), rng.randint(1, 12_000)
        rows.append((k, "a", "c", x, x + rng.randint(20, 200), y, y + rng.randint(20, 200)))
    shared = spark.conf.get("spark.checkpoint.dir")
    table = spark.createDataFrame(rows, BOXES).repartition(4).cache()
    table.count()
    before = stored_bytes(shared)
    assert clusters.cluster_boxes(table, 150).count() == 6000
    assert stored_bytes(shared) - before < 100 * 6000
