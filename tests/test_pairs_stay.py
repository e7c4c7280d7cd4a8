"""Pairs of regions are not dealt again to meet the regions."""

import pytest

from tagplane.operators import interactions
from tagplane.plans import registry

SF = "/root/testdata/sf0.01"
NAMES = ("anchors", "targets", "pair_distance", "distance_filter", "interchrom_filter", "valid_set", "validity")


@pytest.mark.parametrize("name", NAMES)
def test_regions_go_to_the_pairs(spark, name):
    """Whatever Spark thinks of their size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.rindex("MapInArrow")]
    above = above[: above.index("MapInArrow")] if "MapInArrow" in above else above
    assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above and "ShuffledHashJoin" not in above


def test_many_regions_are_dealt_by_id(spark, monkeypatch):
    want = registry.QUERIES["pair_distance"](spark, SF).collect()
    monkeypatch.setattr(interactions, "FEW_REGIONS", 99)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = registry.QUERIES["pair_distance"](spark, SF)
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert want and sorted(map(repr, found.collect())) == sorted(map(repr, want))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
