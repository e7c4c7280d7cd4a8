"""Statistics on counts: abundances, scaling factors, tests with closed forms, multiple testing, designs.

Scaling factors are the trimmed mean of log ratios, with or without precision weights, a published
method; log abundances add a prior count scaled by library size. Fits of count models are in `models`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagplane.functions.graph import checkpoint
from tagplane.functions.ordered import cumulated, least_from_here, quantiles


def log_cpm(counts: DataFrame, totals: dict[str, int], prior: float = 2.0) -> DataFrame:
    """Log2 counts per million of each library; the prior is scaled by the library's share of the mean total."""
    mean = sum(totals.values()) / len(totals)
    out = []
    for f, total in totals.items():
        more = prior * total / mean
        out.append(F.log2((F.col(f"`{f}`") + more) / (total + 2 * more) * 1e6).alias(f))
    return counts.select("anchor_id", "target_id", *out)


def log_mean(totals: dict[str, int], prior: float = 2.0) -> Column:
    """The log of the mean of scaled counts (an approximation; `models.fitted_log_cpm` fits it)."""
    mean = sum(totals.values()) / len(totals)
    scaled = reduce(add, [F.col(f"`{f}`") / F.lit(float(t)) * F.lit(mean) for f, t in totals.items()]) / len(totals)
    return F.log2((scaled + prior) / (mean + 2 * prior) * 1e6)


def average_log_cpm(counts: DataFrame, totals: dict[str, int], prior: float = 2.0) -> DataFrame:
    """The counts with ave_log_cpm; see `log_mean`."""
    return counts.withColumn("ave_log_cpm", log_mean(totals, prior))


def scaled_threshold(counts: DataFrame, totals: dict[str, int], scale: float, fold: float = 5.0) -> DataFrame:
    """threshold: median log abundance on areas ``scale`` times as large, brought to this area, plus log2 fold."""
    mean = sum(totals.values()) / len(totals)
    scaled = reduce(add, [F.col(f"`{f}`") / F.lit(float(t)) * F.lit(mean) for f, t in totals.items()]) / len(totals)
    levels = counts.select(F.lit(0).alias("all"), F.log2((scaled / scale + 2.0) / (mean + 4.0) * 1e6).alias("level"))
    return quantiles(levels, "all", "level", (0.5,)).select((F.col("quantiles")[0] + F.log2(F.lit(fold))).alias("threshold"))


def ma_values(counts: DataFrame, one: str, two: str) -> DataFrame:
    """m: log2 ratio, a: mean log2 of two columns, each plus a half."""
    x, y = F.log2(F.col(f"`{one}`") + 0.5), F.log2(F.col(f"`{two}`") + 0.5)
    return counts.select("anchor_id", "target_id", (x - y).alias("m"), ((x + y) / 2).alias("a"))


def hwe_chisq(aa: Column, ab: Column, bb: Column) -> tuple[Column, Column]:
    """Chi-square of three linker counts against free combination, and its p-value on two degrees."""
    n = aa + ab + bb
    a = (2 * aa + ab) / n / 2
    expected = [n * a * a, n * 2 * a * (1 - a), n * (1 - a) * (1 - a)]
    stat = reduce(add, [F.pow(o - e, 2) / e for o, e in zip((aa, ab, bb), expected, strict=True)])
    return stat, F.exp(-stat / 2)


def bh_adjust(tests: DataFrame, p: str = "pvalue", out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg: least p * n / rank from here up; null p-values stay null and are no tests.

    Rows are counted per distinct p-value, so that ties cost nothing; ranks and running minima are taken
    in parts of the ordered p-values.
    """
    tests = checkpoint(tests)
    each = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    ranked = checkpoint(cumulated(each, (p,), "_n", "_rank"))
    n = ranked.agg(F.max("_rank")).first()[0] or 0
    adjusted = least_from_here(ranked, p, F.col(p) * F.lit(n) / F.col("_rank"), out)
    return tests.join(adjusted.select(p, F.least(F.lit(1.0), out).alias(out)), p, "left")


def tmm_factors(counts: DataFrame, totals: dict[str, int], reference: str, trim_m: float = 0.3, trim_a: float = 0.05, weighted: bool = False) -> DataFrame:
    """file, factor: trimmed mean of log ratios to a reference column, scaled to a geometric mean of one.

    Rows with a zero on either side are left out; those outside the trimmed quantiles of ratio or
    abundance too. Weights are the inverse of the variance that the counts of a row give its log ratio.
    """
    counts = checkpoint(counts)
    ref, ref_total = F.col(f"`{reference}`"), float(totals[reference])
    shares = []
    for f, total in totals.items():
        own = F.col(f"`{f}`")
        ratio = F.log2(own / total / (ref / ref_total))
        level = F.log2(own / total * (ref / ref_total)) / 2
        spread = (1 - own / total) / own + (1 - ref / ref_total) / ref
        both = F.struct(F.lit(f).alias("file"), ratio.alias("m"), level.alias("a"), (1 / spread).alias("w"))
        shares.append(F.when((own > 0) & (ref > 0), both))
    long = checkpoint(counts.select(F.explode(F.array_compact(F.array(*shares))).alias("x")).select("x.*"))
    qm = quantiles(long, "file", "m", (trim_m, 1 - trim_m), "qm")
    qa = quantiles(long, "file", "a", (trim_a, 1 - trim_a), "qa")
    limits = F.broadcast(qm.join(qa, "file"))  # a row per library
    kept = long.join(limits, "file").where("m between qm[0] - 1e-9 and qm[1] + 1e-9 and a between qa[0] - 1e-9 and qa[1] + 1e-9")
    weight = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0) if weighted else F.lit(1.0)
    # The reference has no variance against itself: all its ratios are zero, whatever the weight.
    logs = checkpoint(kept.groupBy("file").agg((F.sum(F.col("m") * weight) / F.sum(weight)).alias("log_factor")))
    mean = logs.agg(F.avg("log_factor")).first()[0] or 0.0
    return logs.select("file", F.pow(F.lit(2.0), F.col("log_factor") - F.lit(mean)).alias("factor"))


def design(info: DataFrame, libraries: Sequence[str]) -> DataFrame:
    """file, intercept, a 0/1 column for each library after the first, and hetero: a paired-samples design.

    One row per column of the counts; ``info`` has file, libname and hetero.
    """
    others = [(F.col("libname") == x).cast("int").alias(x) for x in libraries[1:]]
    return info.select("file", F.lit(1).alias("intercept"), *others, F.col("hetero").cast("int").alias("hetero"))


def one_way_design(info: DataFrame, group: str, levels: Sequence[str]) -> DataFrame:
    """file and a 0/1 column for each level of a column of ``info``: a one-way layout without intercept."""
    return info.select("file", *[(F.col(group) == x).cast("int").alias(x) for x in levels])


def count_list(info: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """file, lib_size, norm_factor: what a count model needs beside the counts; factors are one where none are given."""
    if factors is None:
        return info.select("file", F.col("totals").alias("lib_size"), F.lit(1.0).alias("norm_factor"))
    return info.join(factors, "file", "left").select("file", F.col("totals").alias("lib_size"), F.coalesce("factor", F.lit(1.0)).alias("norm_factor"))
