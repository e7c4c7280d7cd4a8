"""From raw documents to weighted shards: five stages, each over all that the one before it kept.

The stages drop what the quality classifier rejects, keep one document of each group of near-duplicates,
drop documents that leak benchmark items, draw documents to the target mixture, and deal the rest into
shards. All but the last return the columns of documents. No stage is expressible in SQL (a trained
model, hash sketches, raking to convergence), so there is no oracle. The tests compare the first stage
with the model's margins, near-duplicates with all pairs, decontamination with plain window matching,
and the other stages by the laws that they must keep.

Defined cases, in every stage: documents without text are judged as empty texts; repeated rows are
judged alike and stay repeated, but for near-duplicates, where one id is one document; rows without an
id stay unless their text decides against them; an empty table gives an empty result; further columns
are kept whatever their names, but for the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagplane.llm import decontamination, mixing, near_dups, quality_model, sharding
from tagplane.llm.common import written

STAGES = [
    ("quality_classifier", quality_model.stage),
    ("near_dedup", near_dups.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
