"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from tagplane.plans import registry

SF = "/root/testdata/sf0.001"
RICHER = "/root/testdata/sf0.01"
#: These need more regions than the smallest tables have.
ON_RICHER = {"count_regions", "count_regions_ext", "compress_matrix", "pair_distance", "distance_filter", "interchrom_filter", "subset", "anchors", "targets", "default_totals", "abundance_filter"}


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    found = {}
    for sf in (SF, RICHER):
        db = duckdb.connect()
        for f in os.listdir(sf):
            db.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
        found[sf] = db
    return found


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    sf = RICHER if name in ON_RICHER else SF
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    rel = duck[sf].execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rel.fetchall())
    assert ours == theirs


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
