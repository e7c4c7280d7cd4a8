"""The registered queries on tables of odd rows: nulls, empty and long texts, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

from tagplane.llm.queries import QUERIES

FIELDS = {
    "op1_elias_fano": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op2_weak_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_factorisation": ["doc_id", "held_out", "score", "predicted"],
    "op9_raked_mixture": ["doc_id", "source", "lang", "topic", "n_tokens", "rate", "kept"],
    "op12_token_parquet": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_virtual_slots": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.fixture(scope="module")
def odd_dir(spark, odd_docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    odd_docs.write.parquet(str(path / "documents.parquet"))
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, None), (6, 0, 1), (None, 1, 0), (7, None, 0), (8, 3, 0)], "doc_id long, quality int, toxic int")
    labels.withColumn("score", F.lit("clash")).write.parquet(str(path / "labels.parquet"))
    items = spark.createDataFrame([(1, "one"), (1, None), (2, ""), (None, "one"), (3, "lonely words here")], "item_id long, text string")
    items.write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.mark.parametrize("name", sorted(FIELDS))
def test_a_row_for_each_document(spark, odd_dir, odd_docs, name):
    out = QUERIES[name](spark, odd_dir)
    assert out.columns[: len(FIELDS[name])] == FIELDS[name]
    rows = out.collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    assert sorted(map(key, rows)) == sorted(map(key, odd_docs.collect()))
    never_null = set(FIELDS[name]) - {"doc_id", "grown_shard"}
    assert all(r[c] is not None for r in rows for c in never_null)


def test_searches_on_odd_tables(spark, odd_dir):
    assert QUERIES["op6_patience"](spark, odd_dir).collect() == []
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_template_windows"](spark, odd_dir).collect()}
    assert found == {(4, 1), (10, 1)}
