"""Linker splitting: classify read pairs by the linkers at their ends and cut these off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagplane.functions.alignment import segment_scores


def _check(linker_a: str, linker_b: str) -> None:
    for s in (linker_a, linker_b):
        if not s or set(s.upper()) - set("ACGT"):
            raise ValueError("linkers must hold A, C, G and T only")
    if len(linker_a) != len(linker_b):
        raise ValueError("linkers must have one length")


def cut_point(seq: Column, n: int, start: int | None) -> Column:
    """Bases before the linker; each mate has its own."""
    return F.length(seq) - n if start is None else F.lit(start - 1)


def split_linkers(
    pairs: DataFrame, linker_a: str, linker_b: str, min_score: int = 10, start: int | None = None, read_prefix: str | None = None, **costs: int
) -> DataFrame:
    """The read pairs with linker class (AA, AB, BB, other), renamed headers and trimmed sequences.

    A segment is scored once however many reads carry it; the scores come back by a join on it.
    """
    _check(linker_a, linker_b)
    n = len(linker_a)
    at = {m: cut_point(F.col(f"seq{m}"), n, start) for m in (1, 2)}
    cut = pairs.withColumns({f"_seg{m}": F.upper(F.substring(F.col(f"seq{m}"), at[m] + 1, F.lit(n))) for m in (1, 2)})
    segments = cut.select(F.explode(F.array("_seg1", "_seg2")).alias("segment"))
    a, b = F.col("score_a"), F.col("score_b")
    kind = F.when((a > b) & (a >= min_score), "A").when((b > a) & (b >= min_score), "B")
    kinds = segment_scores(segments, {"a": linker_a, "b": linker_b}, **costs).select("segment", kind.alias("kind"))
    for m in (1, 2):
        cut = cut.join(kinds.select(F.col("segment").alias(f"_seg{m}"), F.col("kind").alias(f"_kind{m}")), f"_seg{m}", "left")
    both = F.concat("_kind1", "_kind2")
    linker = F.when(both.isNull(), "other").when(both == "BA", "AB").otherwise(both)
    name = lambda m: F.col(f"header{m}") if read_prefix is None else F.concat(F.lit(f"@{read_prefix}."), F.col("pair_id") + 1)
    out = [F.col("pair_id"), linker.alias("linker")]
    for m in (1, 2):
        out += [name(m).alias(f"header{m}")]
        out += [F.substring(F.col(f"seq{m}"), F.lit(1), at[m]).alias(f"seq{m}"), F.col(f"plus{m}"), F.substring(F.col(f"qual{m}"), F.lit(1), at[m]).alias(f"qual{m}")]
    return cut.select(*out)
