"""Interaction sets: counts of pairs of regions, the libraries they come from, and the regions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagplane.functions.tags import pair_distance
from tagplane.operators.models import loess_offsets
from tagplane.operators.stats import bh_adjust, count_list, log_mean, tmm_factors

#: Regions up to which they are broadcast to the pairs, some 40 MB; beyond, both are dealt by id.
FEW_REGIONS = 500_000


def met_by_pairs(regions: DataFrame) -> DataFrame:
    """Regions for a join with pairs, which may be as many as regions squared: they stay where they are counted."""
    return F.broadcast(regions) if regions.limit(FEW_REGIONS + 1).count() <= FEW_REGIONS else regions


@dataclass(frozen=True)
class InteractionSet:
    """``counts`` has anchor_id, target_id and a column per library of ``files``; ``info`` has a row
    per library (file, totals and what else is known); ``regions`` has region_id, chr, start, end."""

    counts: DataFrame
    info: DataFrame
    regions: DataFrame
    files: tuple[str, ...]

    @staticmethod
    def make(counts: DataFrame, regions: DataFrame, files: Sequence[str], info: DataFrame | None = None) -> InteractionSet:
        """Counts become whole numbers; totals are column sums where none are given."""
        counts = counts.select(F.col("anchor_id").cast("long"), F.col("target_id").cast("long"), *[F.col(f"`{f}`").cast("long").alias(f) for f in files])
        if info is None:
            sums = counts.agg(*[F.coalesce(F.sum(f"`{f}`"), F.lit(0)).alias(f) for f in files])
            info = sums.unpivot([], [F.col(f"`{f}`") for f in files], "file", "totals")
        return InteractionSet(counts, info, regions, tuple(files))

    def problems(self) -> DataFrame:
        """problem, n: broken invariants; empty for a valid set.

        Rows: missing ids, ids under one, ids without a region, a target above its anchor, negative or
        missing counts; all in one pass over the pairs. Libraries: not one row of information for each, or totals that are no number.
        """
        a, t = F.col("anchor_id"), F.col("target_id")
        bad_count = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"`{f}`") < 0, F.lit(True)) for f in self.files], F.lit(False))
        rules = {"missing_id": a.isNull() | t.isNull(), "anchor_not_positive": a < 1, "target_not_positive": t < 1, "order": a < t, "negative": bad_count}
        known = met_by_pairs(self.regions.where("region_id is not null").select("region_id").distinct())
        sides = {side: known.select(F.col("region_id").alias(f"_{side}")) for side in ("anchor", "target")}
        seen = self.counts
        for side, there in sides.items():
            seen = seen.join(there, F.col(f"{side}_id") == F.col(f"_{side}"), "left")
            rules[f"unknown_{side}"] = F.col(f"{side}_id").isNotNull() & F.col(f"_{side}").isNull()
        rows = seen.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()]).unpivot([], list(rules), "problem", "n")
        total = F.col("totals").try_cast("double") if "totals" in self.info.columns else F.lit(None).cast("double")
        libraries = self.info.agg(F.abs(F.count_if(F.col("file").isin(*self.files)) - len(self.files)).alias("libraries"), F.count_if(total.isNull()).alias("totals"))
        return rows.unionByName(libraries.unpivot([], ["libraries", "totals"], "problem", "n")).where("n > 0")

    def subset(self, rows: Column | None = None, files: Sequence[str] | None = None) -> InteractionSet:
        """Some pairs and libraries; ids, regions and totals stay as they are."""
        out = self
        if rows is not None:
            out = replace(out, counts=out.counts.where(rows))
        if files is not None:
            keep = out.counts.select("anchor_id", "target_id", *[F.col(f"`{f}`") for f in files])
            out = replace(out, counts=keep, info=out.info.where(F.col("file").isin(*files)), files=tuple(files))
        return out

    def dim(self) -> tuple[int, int]:
        return self.counts.count(), len(self.files)

    def _side(self, side: str) -> DataFrame:
        places = met_by_pairs(self.regions.select(F.col("region_id").alias(f"{side}_id"), "chr", "start", "end"))
        return self.counts.join(places, f"{side}_id").select("anchor_id", "target_id", "chr", "start", "end")

    def dimnames(self) -> tuple[None, tuple[str, ...]]:
        """Pairs have no names of their own; columns are named by library."""
        return None, self.files

    def anchors(self, ids: bool = False) -> DataFrame:
        """The first region of each pair, or its id alone."""
        return self.counts.select("anchor_id", "target_id") if ids else self._side("anchor")

    def targets(self, ids: bool = False) -> DataFrame:
        return self.counts.select("target_id", "anchor_id") if ids else self._side("target")

    def normalize(self, totals: dict[str, int], reference: str | None = None, weighted: bool = True) -> DataFrame:
        """file, factor: scaling factors of the libraries; see `stats.tmm_factors`."""
        return tmm_factors(self.counts, totals, reference or self.files[0], weighted=weighted)

    def loess_offsets(self, totals: dict[str, int], abundance: Column | None = None) -> DataFrame:
        """Offsets of each pair and library by local regression on abundance (the log mean, if none is given); see `models.loess_offsets`."""
        return loess_offsets(self.counts, log_mean(totals) if abundance is None else abundance, self.files)

    def count_list(self, factors: DataFrame | None = None) -> DataFrame:
        return count_list(self.info, factors)

    def result_table(self, tests: DataFrame, p: str = "pvalue") -> DataFrame:
        """Pairs with both regions, what ``tests`` has for them and the false discovery rate, least p first."""
        places = met_by_pairs(self.regions.select("region_id", "chr", "start", "end"))
        side = lambda x: places.select(F.col("region_id").alias(f"{x}_id"), *[F.col(c).alias(f"{x}_{c}") for c in ("chr", "start", "end")])
        judged = bh_adjust(tests, p).join(side("anchor"), "anchor_id").join(side("target"), "target_id")
        first = [f"{x}_{c}" for x in ("anchor", "target") for c in ("chr", "start", "end")]
        return judged.select(*first, *[c for c in judged.columns if c not in first and not c.endswith("_id")]).orderBy(p, *first)

    def distances(self) -> DataFrame:
        """The counts with the distance between both regions; null between chromosomes."""
        places = met_by_pairs(self.regions.select("region_id", "chr", "start", "end"))
        side = lambda p: places.select(F.col("region_id").alias(f"{p}_id"), *[F.col(c).alias(f"_{p}_{c}") for c in ("chr", "start", "end")])
        both = self.counts.join(side("anchor"), "anchor_id").join(side("target"), "target_id")
        where = [F.col(f"_{p}_{c}") for p in ("anchor", "target") for c in ("chr", "start", "end")]
        return both.select("anchor_id", "target_id", *[F.col(f"`{f}`") for f in self.files], pair_distance(*where).alias("distance"))

    def compress(self, library: dict[str, str] | None = None, hetero: dict[str, bool] | None = None) -> InteractionSet:
        """Sum the columns of each library and linker kind; see `roll_up`."""
        return roll_up(self, library, hetero)

    def show(self, n: int = 10) -> None:
        """Print the first five pairs if there are more than ``n``, else all."""
        print(f"{self.dim()[0]} pairs, {len(self.files)} libraries")
        self.counts.show(5 if self.counts.limit(n + 1).count() > n else n)
        self.info.show()


def library_of(file: Column) -> Column:
    return F.regexp_replace(file, r"_(AA|AB|BB|other)(\.[^.]+)?$", "")


def is_hetero(file: Column) -> Column:
    return F.contains(file, F.lit("AB"))


def roll_up(data: InteractionSet, library: dict[str, str] | None = None, hetero: dict[str, bool] | None = None) -> InteractionSet:
    """Columns of one library with the same or with mixed linkers are added up: `<library>hom`, `<library>het`.

    Totals are those of a library over both kinds. Without names given, a library is the file's name
    without its linker suffix, and a file is mixed if its name has AB.
    """
    import re

    library = library or {f: re.sub(r"_(AA|AB|BB|other)(\.[^.]+)?$", "", f) for f in data.files}
    hetero = hetero or {f: "AB" in f for f in data.files}
    if set(library) != set(data.files) or set(hetero) != set(data.files):
        raise ValueError("each library needs a name and a kind")
    groups = sorted({(library[f], hetero[f]) for f in data.files})
    name = lambda lib, het: f"{lib}{'het' if het else 'hom'}"
    columns = [
        reduce(add, [F.col(f"`{f}`") for f in data.files if (library[f], hetero[f]) == g]).alias(name(*g)) for g in groups
    ]
    spark = data.counts.sparkSession
    named = spark.createDataFrame([(f, library[f]) for f in data.files], "file string, libname string")
    kinds = spark.createDataFrame([(name(*g), *g) for g in groups], "file string, libname string, hetero boolean")
    totals = data.info.join(named, "file").groupBy("libname").agg(F.sum("totals").alias("totals"))
    info = kinds.join(totals, "libname").select("file", "totals", "hetero", "libname")
    return InteractionSet(data.counts.select("anchor_id", "target_id", *columns), info, data.regions, tuple(name(*g) for g in groups))
