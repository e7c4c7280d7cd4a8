"""Links of boxes by tiles against every two boxes compared."""

import random

from tagplane.operators.clusters import box_links

BOXES = "box_id long, anchor_chr string, target_chr string, start_a long, end_a long, start_t long, end_t long"


def test_links_equal_every_two_boxes(spark):
    """Boxes of four levels, on borders of tiles, some before the first base and many at one place."""
    rng = random.Random(5)
    side = lambda: rng.choice((1, 40, 300, 5000, 70_000))
    rows = []
    for k in range(400):
        x, y = (rng.choice((rng.randint(-500, 30_000), 2048 * rng.randint(0, 9), 4096)) for _ in "at")
        rows.append((k, rng.choice("ab"), rng.choice("cd"), x, x + side(), y, y + side()))
    tol = 50
    near = lambda p, q: p[1:3] == q[1:3] and all(p[i] < q[i + 1] + tol and q[i] < p[i + 1] + tol for i in (3, 5))
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and near(p, q)}
    got = box_links(spark.createDataFrame(rows, BOXES), tol)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    # Links are put out by the task that finds them: boxes are dealt once, and no table of them is stored.
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_boxes(spark):
    assert box_links(spark.createDataFrame([], BOXES), 5).count() == 0
