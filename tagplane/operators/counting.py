"""Counting of tag pairs into pairs of windows or regions, and of tags into regions.

Counts are wide: one row per pair, one column per library, from one aggregation per query. The
libraries are named by the caller, so that the columns do not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagplane.functions.blocks import count_both, count_ends
from tagplane.functions.intervals import Grid, numbered


def _check(files: Sequence[str], ext: int) -> None:
    if not files:
        raise ValueError("at least one library is required")
    if ext < 0:
        raise ValueError("ext must not be negative")


def restricted(pets: DataFrame, restrict: Sequence[str] | None) -> DataFrame:
    """Pairs with both ends on the named chromosomes; prunes partitions of a stored tag table."""
    if restrict is None:
        return pets
    return pets.where(F.col("anchor_chr").isin(*restrict) & F.col("target_chr").isin(*restrict))


def library_totals(pets: DataFrame, restrict: Sequence[str] | None = None) -> DataFrame:
    return restricted(pets, restrict).groupBy("file").agg(F.count("*").alias("totals"))


def weighted(pets: DataFrame) -> DataFrame:
    """Equal points of a library become one with a weight; all counts depend on positions only."""
    return pets.groupBy("file", "anchor_chr", "target_chr", "anchor_pos", "target_pos").agg(F.count("*").alias("weight"))


def _by_file(files: Sequence[str], weight: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("file") == f, weight)), F.lit(0)).cast("long").alias(f) for f in files]


def _having(wide: DataFrame, files: Sequence[str], least: int) -> DataFrame:
    return wide.where(reduce(add, [F.col(f"`{f}`") for f in files]) >= max(int(least), 1))


def count_windows(
    pets: DataFrame, lengths: DataFrame, files: Sequence[str], grid: Grid = Grid(), ext: int = 1, least: int = 20, restrict: Sequence[str] | None = None, weight: str | None = None
) -> DataFrame:
    """anchor_id, target_id and a count per library for window pairs with ``least`` pairs in total; rows with a
    ``weight`` column are so many pairs.

    A pair's two ends become index ranges by arithmetic; equal boxes are added up before they are
    spread over cells. On one chromosome only cells on or below the diagonal count.
    """
    _check(files, ext)
    chroms = numbered(lengths, grid)
    side = lambda p: chroms.select(F.col("chr").alias(f"{p}_chr"), F.col("n").alias(f"_{p}_n"), F.col("before").alias(f"_{p}_before"))
    points = restricted(pets, restrict).where(F.col("file").isin(*files))
    placed = points.join(side("anchor"), "anchor_chr").join(side("target"), "target_chr")
    for p in ("anchor", "target"):
        lo, hi = grid.index(F.col(f"{p}_pos"), ext, F.col(f"_{p}_n"))
        placed = placed.withColumn(f"_{p}_lo", lo).withColumn(f"_{p}_hi", hi)
    same = F.col("anchor_chr") == F.col("target_chr")
    # On one chromosome the further tag has the upper range at both ends, as tags are equally long.
    upper = lambda c: F.when(same, F.greatest(f"_anchor_{c}", f"_target_{c}")).otherwise(F.col(f"_anchor_{c}"))
    lower = lambda c: F.when(same, F.least(f"_anchor_{c}", f"_target_{c}")).otherwise(F.col(f"_target_{c}"))
    ends = {"a0": upper("lo"), "a1": upper("hi"), "t0": lower("lo"), "t1": lower("hi")}
    boxes = (
        placed.where("_anchor_lo <= _anchor_hi and _target_lo <= _target_hi")
        .select("file", same.alias("same"), "_anchor_before", "_target_before", *[v.alias(k) for k, v in ends.items()], (F.lit(1) if weight is None else F.col(weight)).alias("times"))
        .groupBy("file", "same", "_anchor_before", "_target_before", *ends)
        .agg(F.sum("times").alias("weight"))
    )
    cells = (
        boxes.withColumn("a", F.explode(F.sequence("a0", "a1")))
        .withColumn("t", F.explode(F.sequence("t0", "t1")))
        .where(~F.col("same") | (F.col("a") >= F.col("t")))
    )
    one, two = F.col("_anchor_before") + F.col("a"), F.col("_target_before") + F.col("t")
    wide = (
        cells.select("file", "weight", F.greatest(one, two).alias("anchor_id"), F.least(one, two).alias("target_id"))
        .groupBy("anchor_id", "target_id")
        .agg(*_by_file(files, F.col("weight")))
    )
    return _having(wide, files, least)


def _begins(pos: Column, ext: int) -> Column:
    """Where an extended tag begins, before the first base too."""
    return F.when(pos > 0, pos - (ext - 1)).otherwise(F.abs(pos)).cast("long")


def _points(pets: DataFrame, files: Sequence[str], ext: int, restrict: Sequence[str] | None) -> DataFrame:
    """The place of the library in ``files`` as kind, both chromosomes, and where both tags begin; a tag without
    a base on the chromosome is null."""
    kind = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file")).cast("int") - 1
    begins = lambda p: F.when(_begins(F.col(p), ext) + (ext - 1) >= F.greatest(_begins(F.col(p), ext), F.lit(1)), _begins(F.col(p), ext))
    kept = restricted(pets, restrict).where(F.col("file").isin(*files))
    return kept.select(kind.alias("kind"), "anchor_chr", "target_chr", begins("anchor_pos").alias("u"), begins("target_pos").alias("v"))


def count_regions(
    pets: DataFrame, regions: DataFrame, files: Sequence[str], ext: int = 1, least: int = 20, restrict: Sequence[str] | None = None
) -> DataFrame:
    """anchor_id, target_id and a count per library for pairs of regions.

    On one chromosome a pair counts once for two regions, whichever end is in which. Counts are differences of
    running sums (`blocks.count_both`), so that the work follows the pairs of tags and those of regions, but
    not the hits of each tag in all regions around it.
    """
    _check(files, ext)
    return count_both(_points(pets, files, ext, restrict), regions, tuple(files), ext, least)


def count_margins(
    pets: DataFrame,
    regions: DataFrame,
    files: Sequence[str],
    ext: int = 1,
    restrict: Sequence[str] | None = None,
    chromosomes: Sequence[str] | None = None,
) -> DataFrame:
    """region_id and a count per library of the pairs with an end in the region; zeros are kept.

    A pair on one chromosome counts once for a region that holds both ends: ends are counted where they begin,
    and pairs with both ends in a region are taken off once. Pairs that leave the given
    chromosomes (those with regions, if none are given) are skipped as a whole.
    """
    _check(files, ext)
    points = _points(pets, files, ext, restrict)
    if chromosomes is None:
        known = F.broadcast(regions.select("chr").distinct())
        points = points.join(known.withColumnRenamed("chr", "anchor_chr"), "anchor_chr", "left_semi")
        points = points.join(known.withColumnRenamed("chr", "target_chr"), "target_chr", "left_semi")
    else:
        points = restricted(points, chromosomes)
    ends = points.select("kind", F.explode(F.array(F.struct(F.col("anchor_chr").alias("chr"), "u"), F.struct(F.col("target_chr").alias("chr"), F.col("v").alias("u")))).alias("e"))
    counted = ends.select("kind", "e.*").where("u is not null").groupBy("kind", "chr", "u").agg(F.count("*").alias("times"))
    both = points.where("anchor_chr = target_chr and u is not null and v is not null").select("kind", F.col("anchor_chr").alias("chr"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    wide = count_ends(counted, both, regions, tuple(files), ext)
    zeros = {f: 0 for f in files}
    return regions.select("region_id").join(wide, "region_id", "left").fillna(zeros)
