"""Window counts over tag pairs that arrive in batches. Counts only add up, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagplane.functions.intervals import Grid
from tagplane.operators.counting import count_windows
from tagplane.schema import PETS


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(PETS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_window_counts(stream: DataFrame, lengths: DataFrame, files: Sequence[str], out: str, checkpoint: str, grid: Grid = Grid(), ext: int = 1):
    """Append the counts of each batch under its number; a batch that is run again replaces its own.

    The whole is the sum over batches (`total_counts`), so the state never has to be kept in memory.
    """

    def add(batch: DataFrame, number: int) -> None:
        count_windows(batch, lengths, files, grid, ext, least=1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(spark: SparkSession, out: str, files: Sequence[str], least: int = 20) -> DataFrame:
    parts = spark.read.parquet(out)
    sums = parts.groupBy("anchor_id", "target_id").agg(*[F.sum(f"`{f}`").alias(f) for f in files])
    return sums.where(sum((F.col(f"`{f}`") for f in files), F.lit(0)) >= max(least, 1))
