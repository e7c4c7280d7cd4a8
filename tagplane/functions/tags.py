"""Column expressions on signed tag positions; the sign is the strand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(anchor_pos: Column, target_pos: Column) -> Column:
    """Orientation: 0 both forward, 1 inward, 2 outward, 3 both reverse; zero counts as reverse."""
    return F.when(anchor_pos > 0, 0).otherwise(1) + F.when(target_pos > 0, 0).otherwise(2)


def gap(anchor_pos: Column, target_pos: Column) -> Column:
    return F.abs(anchor_pos) - F.abs(target_pos)


def extended(pos: Column, ext: int) -> tuple[Column, Column]:
    """Closed interval of a tag that is extended by ``ext`` against its strand from the 3' end."""
    start = F.when(pos > 0, pos - ext + 1).otherwise(F.abs(pos))
    return F.greatest(start, F.lit(1)), start + ext - 1


def pair_distance(chr_a: Column, start_a: Column, end_a: Column, chr_t: Column, start_t: Column, end_t: Column) -> Column:
    """Bases between two regions, negative where they overlap, null between chromosomes."""
    return F.when(chr_a == chr_t, F.greatest(start_a, start_t) - F.least(end_a, end_t) - 1)
