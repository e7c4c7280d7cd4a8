"""What the training-data operators share: tables, the shared folder, columns that are made safe."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def small(df: DataFrame, rows_per_task: int = 250_000) -> DataFrame:
    """A checkpointed table dealt into one task per so many rows, so that a loop over a table that is
    small does not make hundreds of files a round, and a large one keeps its parallelism."""
    kept = checkpoint(df)
    return kept.coalesce(tasks(kept.count(), rows_per_task))


def tasks(n_rows: int, rows_per_task: int = 250_000) -> int:
    return max(1, -(-n_rows // rows_per_task))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
