"""Rows packed by key, and links of boxes that are dealt packed."""

import random

import numpy as np
import pytest

from tagplane.functions import packed as pk
from tagplane.operators.clusters import box_links
from tagplane.plans import registry

BOXES = "box_id long, anchor_chr string, target_chr string, start_a long, end_a long, start_t long, end_t long"


@pytest.mark.parametrize("keys", [3, 400])
def test_packed_rows_come_back(spark, keys):
    """Keys with many rows, which are compressed, and with few; the ends of 64 bits too."""
    rng = random.Random(keys)
    number = lambda: rng.choice((rng.randint(-9, 9), rng.randint(-(2**63), 2**63 - 1), 2**63 - 1, -(2**63)))
    rows = [(rng.choice("ab"), rng.randint(-keys, keys), number(), number()) for _ in range(900)]
    got = pk.packed(spark.createDataFrame(rows, "c string, k long, x long, y long").repartition(2), ("c", "k"), ("x", "y")).toArrow().combine_chunks()
    assert got.num_rows < 900 and (min(got.column("n").to_pylist()) > 0) == (keys == 3)
    found = []
    for batch in got.to_batches():
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            found += [(row.column("c")[0].as_py(), row.column("k")[0].as_py(), *xy) for xy in pk.unpacked(row, 2).T.tolist()]
    assert sorted(found) == sorted(rows)


def test_boxes_given_twice_are_linked_once(spark):
    rng = random.Random(8)
    rows = [(k, "a", None if k % 17 == 0 else "b", x, x + 30 + 3000 * (k % 9 == 0), y, y + 50) for k in range(300) for x, y in ((rng.randint(-900, 6000), rng.randint(0, 6000)),)]
    near = lambda p, q: p[2] == q[2] and p[2] and all(p[i] < q[i + 1] + 40 and q[i] < p[i + 1] + 40 for i in (3, 5))
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and near(p, q)}
    found = [tuple(r) for r in box_links(spark.createDataFrame(rows * 3, BOXES).repartition(5), 40).collect()]
    assert len(found) == len(want) and set(found) == want


def test_boxes_are_dealt_once_and_packed(spark):
    """One shuffle, in which the boxes of a tile and strip are a row; none for distinct points."""
    sf = "/root/testdata/sf0.01"
    found = registry.QUERIES["cluster_links"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
    assert found.where("a >= b").count() == 0


def test_squeezed_numbers_are_smaller():
    x = np.sort(np.random.default_rng(1).integers(0, 2000, (1, 1000)), axis=1)
    assert len(pk._squeezed(x)) < 2000 and (pk._restored(pk._squeezed(x), 1, 1000) == x).all()
