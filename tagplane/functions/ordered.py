"""Ranks and exact quantiles of columns that are dealt over tasks in order, none of which holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagplane.functions.graph import checkpoint


def dealt(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows dealt over tasks by ranges of the order columns, with _part, the task that holds them; equal
    rows are in one part. They are stored, as the parts must stay as they are."""
    return checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def summed(parts: DataFrame, order: Sequence[str], weight: str, out: str) -> DataFrame:
    """Rows of `dealt` with the sum of the weights up to each row. Sums within a part start where the
    parts before it end; the table of parts has a row per task."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy("_part").agg(F.sum(weight).alias("_n"))
    starts = each.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(out, within).join(F.broadcast(starts), "_part").withColumn(out, (F.col(out) + F.col("_start")).cast("long")).drop("_start")


def cumulated(rows: DataFrame, order: Sequence[str], weight: str, out: str) -> DataFrame:
    """The rows with _part, the task that holds them, and ``out``: the sum of the weights up to each row."""
    return summed(dealt(rows, order), order, weight, out)


def greatest_before(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Rows of `dealt` by keys and order with the greatest value of the earlier rows with their keys; null for the first.

    A key with very many rows is in several parts: the greatest value of its earlier parts is carried on.
    Only the first and the last key of a part can go on, so that a task has two rows in the table of carries.
    """
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*keys)
    ends = parts.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    own = parts.join(F.broadcast(ends), "_part").where((key == F.col("_first")) | (key == F.col("_last"))).groupBy("_part", *keys).agg(F.max(value).alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select("_part", *keys, F.max("_own").over(earlier).alias("_carried")).where("_carried is not null")
    found = parts.withColumn(out, F.max(value).over(within)).join(F.broadcast(carried), ["_part", *keys], "left")
    return found.withColumn(out, F.greatest(out, "_carried")).drop("_carried")


def least_from_here(rows: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """Rows of `cumulated` with the least value of this and all later rows in the order."""
    valued = rows.withColumn("_value", value)
    later = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    parts = valued.groupBy("_part").agg(F.min("_value").alias("_least"))
    rest = parts.select("_part", F.min("_least").over(later).alias("_rest"))
    within = F.min("_value").over(Window.partitionBy("_part").orderBy(F.col(order).desc()))
    found = valued.withColumn(out, within).join(F.broadcast(rest), "_part")
    return found.withColumn(out, F.least(out, "_rest")).drop("_value", "_rest")


def quantiles(rows: DataFrame, key: str, value: str, shares: Sequence[float], out: str = "quantiles") -> DataFrame:
    """key and an array of the exact, interpolated quantiles of each key's values; nulls do not count.

    There are few keys. Values are counted first, then dealt in order; a quantile lies between the values
    that hold the two places next to it.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_times"))
    ranked = checkpoint(cumulated(counted, (key, value), "_times", "_upto"))
    ends = ranked.groupBy(key).agg(F.max("_upto").alias("_last"), F.sum("_times").alias("_all"))
    at = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    # Floating point must not push a whole place off by one.
    floor = lambda p: F.floor(at(p) + 1e-9).cast("long")
    wanted = [F.struct(F.lit(k).alias("k"), (floor(p) + step).alias("place"), (at(p) - floor(p)).alias("part"), F.lit(step).alias("step")) for k, p in enumerate(shares) for step in (0, 1)]
    places = ends.select(key, (F.col("_last") - F.col("_all")).alias("_start"), F.explode(F.array(*wanted)).alias("w"))
    upto = F.col("_upto") - F.col("_start")
    hit = (upto > F.col("w.place")) & (upto - F.col("_times") <= F.col("w.place"))
    met = ranked.join(F.broadcast(places), key).where(hit)  # a row per key and two per share
    weight = F.when(F.col("w.step") == 1, F.col("w.part")).otherwise(1 - F.col("w.part"))
    sums = met.groupBy(key, F.col("w.k").alias("_share")).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias("q"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_share", "q"))), lambda x: x["q"]).alias(out))
