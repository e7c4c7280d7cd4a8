"""Two-dimensional histograms of tag pairs and a plain SVG of them."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    chr: str
    start: int
    end: int

    @property
    def limits(self) -> tuple[float, float]:
        """A tenth more at either side, for points on the edge."""
        more = 0.1 * (self.end - self.start)
        return self.start - more, self.end + more


def heatmap_bins(pets: DataFrame, anchor: Span, target: Span | None = None, width: int = 1000, cap: int = 50, mirror: bool = True) -> DataFrame:
    """mirrored, anchor_bin, target_bin, count, alpha of the pairs within both spans.

    Pairs that are stored the other way round are turned; on one chromosome the mirrored half is
    added, without the cells on the diagonal.
    """
    target = target or anchor
    a, t = F.abs("anchor_pos"), F.abs("target_pos")
    straight = pets.where((F.col("anchor_chr") == anchor.chr) & (F.col("target_chr") == target.chr)).select(a.alias("x"), t.alias("y"), F.lit(False).alias("mirrored"))
    if anchor.chr != target.chr:
        points = straight.unionByName(
            pets.where((F.col("anchor_chr") == target.chr) & (F.col("target_chr") == anchor.chr)).select(t.alias("x"), a.alias("y"), F.lit(False).alias("mirrored"))
        )
    elif mirror:
        points = straight.unionByName(straight.select(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(True).alias("mirrored")))
    else:
        points = straight
    inside = F.col("x").between(*anchor.limits) & F.col("y").between(*target.limits)
    bins = points.where(inside).groupBy("mirrored", F.floor(F.col("x") / width).alias("anchor_bin"), F.floor(F.col("y") / width).alias("target_bin"))
    counted = bins.agg(F.count("*").alias("count")).where("not mirrored or anchor_bin <> target_bin")
    return counted.withColumn("alpha", F.least(F.lit(1.0), F.col("count") / cap))


def write_svg(bins: DataFrame, path: str, anchor: Span, target: Span | None = None, width: int = 1000, colour: str = "red", most: int = 200_000) -> None:
    """Draw the bins; a picture holds ``most`` cells at most and is refused beyond."""
    target = target or anchor
    cells = bins.limit(most + 1).collect()
    if len(cells) > most:
        raise ValueError("too many cells for a picture; choose wider bins")
    rows = [
        f'<rect x="{r["anchor_bin"] * width - anchor.start}" y="{target.end - (r["target_bin"] + 1) * width}" width="{width}" height="{width}" fill="{colour}" fill-opacity="{r["alpha"]:.3f}"/>'
        for r in cells
    ]
    size = f"0 0 {anchor.end - anchor.start} {target.end - target.start}"
    Path(path).write_text("\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{size}">', *rows, "</svg>"]))
