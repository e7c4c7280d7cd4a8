"""Raking, slots and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagplane.llm import mixing, quality_model, sharding
from tagplane.llm.words import word_slices

from .conftest import SF, words
from .test_filters import brute_leaks
from .test_near_dups import brute


CELLS = "source string, lang string, topic string, tokens long"


def test_raking_meets_marginals(spark):
    rng = random.Random(6)
    cells = [(f"s{i}", lang, topic, rng.randint(1, 1000)) for i in range(6) for lang in ("en", "de", None) for topic in ("prose", "table") if rng.random() < 0.9]
    named = [(s, lang or mixing.NONE, t, n) for s, lang, t, n in cells]
    # A small budget, so that no category and no cell is used up.
    targets = mixing.Targets(lang={"en": 0.5, "de": 0.3}, topic={"prose": 0.9, "table": 0.1}, rest=0.2, budget=0.05, tolerance=1e-5)
    got, miss, _ = mixing.rake(spark.createDataFrame(named, CELLS), targets)
    total = sum(n for *_, n in named)
    share = {(r["source"], r["lang"], r["topic"]): r["wanted"] / (0.05 * total) for r in got.collect()}
    assert miss <= 1e-5
    # The same by hand.
    own = defaultdict(float)
    for s, _, _, n in named:
        own[s] += n
    goals = [{s: n**0.7 / sum(v**0.7 for v in own.values()) for s, n in own.items()}, {"en": 0.5, "de": 0.3, mixing.NONE: 0.2}, {"prose": 0.9, "table": 0.1}]
    w = {c[:3]: c[3] / total for c in named}
    for _ in range(200):
        for m, goal in enumerate(goals):
            sums = defaultdict(float)
            for k, v in w.items():
                sums[k[m]] += v
            w = {k: v * goal[k[m]] / sums[k[m]] for k, v in w.items()}
    assert share.keys() == w.keys()
    assert all(share[k] == pytest.approx(w[k], abs=1e-4) for k in w)


def test_what_is_short_is_used_up_and_made_up_for(spark):
    """A category with too few tokens gives all, and a cell that is too small too; the marginals still hold."""
    cells = [("a", "en", "prose", 5000), ("a", "de", "prose", 900), ("b", "en", "prose", 1900), ("b", "de", "prose", 2500), ("b", "en", "short", 60), ("a", "en", "short", 40)]
    targets = mixing.Targets(source={"a": 0.5, "b": 0.5}, lang={"en": 0.5, "de": 0.5}, topic={"prose": 0.8, "short": 0.2}, budget=0.5, tolerance=1e-3)
    got, miss, _ = mixing.rake(spark.createDataFrame(cells, CELLS), targets)
    rows = got.collect()
    assert miss <= 1e-3 and all(r["wanted"] <= r["tokens"] for r in rows)
    budget = 0.5 * sum(c[3] for c in cells)
    by = lambda m, k: sum(r["wanted"] for r in rows if r[m] == k)
    assert by("topic", "short") == pytest.approx(100) and by("topic", "prose") == pytest.approx(budget - 100, rel=2e-3)
    for m, k in (("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "de")):
        assert by(m, k) == pytest.approx(budget / 2, rel=2e-3)


def test_a_miss_is_reported(spark):
    cells = spark.createDataFrame([("a", "en", "prose", 100), ("b", "de", "short", 100)], CELLS)
    with pytest.warns(mixing.Missed):
        mixing.cell_rates(cells, mixing.Targets(source={"a": 0.9, "b": 0.1}, lang={"en": 0.1, "de": 0.9}, topic={"prose": 1.0, "short": 1.0}, budget=0.3, max_rounds=5))


def test_mixing_query(spark, small_texts):
    """The expected sample meets the production targets within one per cent, or all of a category is in it."""
    rows = mixing.op9_raked_mixture(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(words(t)) for i, t in small_texts.items()}
    rates, have, taken = defaultdict(set), defaultdict(float), defaultdict(float)
    for r in rows:
        rates[r["source"], r["lang"], r["topic"]].add(r["rate"])
        assert 0 <= r["rate"] <= 1 and (r["rate"] < 1 or r["kept"])
        for m in mixing.MARGINS:
            have[m, r[m]] += r["n_tokens"]
            taken[m, r[m]] += r["n_tokens"] * r["rate"]
    assert all(len(v) == 1 for v in rates.values())
    total = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["rate"] for r in rows) == pytest.approx(0.6 * total, rel=0.01)
    own = {k: v for k, v in have.items() if k[0] == "source"}
    flat = sum(v**0.7 for v in own.values())
    raw = {k: v**0.7 / flat for k, v in own.items()} | {("lang", k): v for k, v in mixing.PRODUCTION.lang.items()} | {("topic", k): v for k, v in mixing.PRODUCTION.topic.items()}
    for m in mixing.MARGINS:
        open_ = {k for k in have if k[0] == m and taken[k] < have[k] * 0.99}
        spare = (0.6 * total - sum(have[k] for k in have if k[0] == m and k not in open_)) / sum(raw[k] for k in open_)
        for k in open_:
            assert taken[k] == pytest.approx(raw[k] * spare, rel=0.01)
        for k in have:
            if k[0] == m and k not in open_:
                assert raw[k] * spare >= have[k] * 0.98


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    out = mixing.sampled(odd_docs)
    assert out.count() == 13 and out.where("_mix_rate is null or _mix_draw is null").count() == 0
    assert out.where("doc_id is null").select("_mix_draw").distinct().count() == 2
    assert mixing.stage(spark, odd_docs, "").columns == odd_docs.columns
    assert mixing.sampled(no_docs).count() == 0


def test_sharding_query(spark, small_texts):
    rows = sharding.op10_virtual_slots(spark, SF).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["size"] == len(small_texts[r["doc_id"]].encode()) + 8
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(small_texts)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    biggest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= biggest


def test_map_edits_move_little(spark, tmp_path):
    draw = np.random.Generator(np.random.PCG64(5))
    load = {s: int(x) for s, x in enumerate(draw.lognormal(8, 1, 512))}
    first = sharding.rebalance(sharding.SlotMap.empty(512, 8), load, 8)
    grown = sharding.rebalance(first, load, 9)
    moved = [s for s in range(512) if first.owner[s] != grown.owner[s]]
    assert grown.version == 2 and sum(load[s] for s in moved) < 0.2 * sum(load.values())
    filled = [sum(load[s] for s in range(512) if grown.owner[s] == k) for k in range(9)]
    assert max(filled) - min(filled) < 0.02 * sum(filled) / 9 + min(load.values())
    shrunk = sharding.rebalance(grown, load, 4)
    assert set(shrunk.owner) <= set(range(4))
    for m in (first, grown):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_stored_map_is_edited(spark, small_docs, tmp_path):
    """A second run edits the version that the first one stored, and the rows follow the stored table."""
    path = str(tmp_path / "map")
    sharding.SlotMap.empty(64, 4).save(spark, path)
    rows, first = sharding.assign(small_docs, n_shards=4, n_slots=64, store=path)
    assert first.version == 1 and sharding.SlotMap.load(spark, path) == first
    assert all(first.owner[r["vslot"]] == r["shard"] for r in rows.collect())
    again, second = sharding.assign(small_docs, n_shards=5, n_slots=64, store=path)
    assert second.version == 2 and second.n_shards == 5
    assert all(second.owner[r["vslot"]] == r["shard"] for r in again.collect())
    moved = [s for s in range(64) if first.owner[s] != second.owner[s]]
    assert 0 < len(moved) < 32
    # Versions keep their number of shards even where the last shard is empty.
    sharding.SlotMap(3, 9, second.owner).save(spark, path)
    assert sharding.SlotMap.load(spark, path).n_shards == 9


def test_sharding_odd_rows(spark, odd_docs, no_docs):
    rows, owned = sharding.assign(odd_docs, n_shards=3, n_slots=64)
    got = rows.collect()
    assert len(got) == 13 and owned.version == 1
    for s in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.assign(no_docs)[0].count() == 0
    assert sharding.stage(spark, odd_docs, "").count() == 13 and sharding.stage(spark, no_docs, "").count() == 0


def test_pipeline(spark, small_docs):
    """Stage by stage against plain versions: what each keeps of all that the one before it kept."""
    docs = small_docs
    columns = docs.columns
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k == 4:
            break
        assert out.columns == columns
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(out.collect(), small_docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert 0 < len(after) == docs.count() and all(before[i] == t for i, t in after.items())
        if name == "quality_classifier":
            model = quality_model.train(small_docs, spark.read.parquet(f"{SF}/labels.parquet"))
            part = pa.array([small for small in before.values()])
            chars = np.array([r["n_chars"] for r in small_docs.collect()])
            found, ids = [], list(before)
            for w in word_slices(part, lower=True):
                found += [ids[w.first + i] for i in np.flatnonzero(model.margins(w, chars[w.rows]) >= 0)]
            assert set(found) == set(after)
        if name == "near_dedup":
            assert {i for i, (_, _, kept) in brute(before, 5).items() if kept} == set(after)
        if name == "decontamination":
            leak, apart = brute_leaks(list(before.items()), benchmark)
            assert not {d for d, _ in leak} & set(after)
            assert {d for d in before if all((d, i) in apart for i, _ in benchmark)} <= set(after)
        if name == "mixing":
            drawn = mixing.sampled(docs.sparkSession.createDataFrame([(i, before[i], None, None, None) for i in before], small_docs.schema))
            assert drawn.count() == len(before) and len(after) < len(before)
    assert out.count() == docs.count()
    assert out.select(F.countDistinct("doc_id")).first()[0] == docs.count()
    assert docs.select(F.countDistinct("text")).first()[0] == docs.count()


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """Clashing columns stay, and an empty table gives an empty one."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF)
        if name != "sharding":
            assert out.columns == odd_docs.columns
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd_docs.collect()}
        assert stage(spark, no_docs, SF).count() == 0
