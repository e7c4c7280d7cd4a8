"""Count models: fitted abundances, local-regression offsets, dispersions and tests of negative binomial fits.

Published methods, written for tables of pairs: what a pair needs is computed where the pair is, and what all
pairs share (sums at knots, likelihoods of a grid) is added up in the tasks before it is moved. Tables of a row
per library (designs, offsets) are small and known to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagplane.functions.graph import checkpoint
from tagplane.functions.ordered import cumulated

IDS = ["anchor_id", "target_id"]
#: Steps of the abundance fit; each doubles the number of right digits once it is near.
STEPS = 40


def fitted_log_cpm(counts: DataFrame, totals: dict[str, int], dispersion: float = 0.05, prior: float = 2.0) -> DataFrame:
    """ave_log_cpm: log2 of the mean of a negative binomial fit per million, at a given dispersion.

    A prior count, scaled by library size, is added to the counts and twice to the sizes. The likelihood's
    slope is set to zero by scoring steps from the Poisson mean, within bounds that a solution cannot leave.
    """
    mean = sum(totals.values()) / len(totals)
    more = {f: prior * t / mean for f, t in totals.items()}
    size = {f: t + 2 * more[f] for f, t in totals.items()}
    pairs = F.array(*[F.struct((F.col(f"`{f}`") + F.lit(more[f])).alias("y"), F.lit(float(size[f])).alias("l")) for f in totals])
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    with_pairs = counts.withColumn("_pairs", pairs)
    begin = F.log(total(F.col("_pairs"), lambda x: x["y"]) / F.lit(sum(size.values())))
    lowest = F.array_min(F.transform("_pairs", lambda x: F.log(x["y"] / x["l"])))
    highest = F.array_max(F.transform("_pairs", lambda x: F.log(x["y"] / x["l"])))

    def step(b: Column, _: Column) -> Column:
        mu = lambda x: x["l"] * F.exp(b)
        slope = total(F.col("_pairs"), lambda x: (x["y"] - mu(x)) / (1 + dispersion * mu(x)))
        bend = total(F.col("_pairs"), lambda x: mu(x) / (1 + dispersion * mu(x)))
        return F.greatest(F.col("_low"), F.least(F.col("_high"), b + slope / bend))

    found = with_pairs.withColumns({"_low": lowest, "_high": highest, "_begin": begin})
    b = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("_begin"), step)
    return found.withColumn("ave_log_cpm", (b + F.lit(math.log(1e6))) / F.lit(math.log(2.0))).drop("_pairs", "_low", "_high", "_begin")


#: Knots of the local regression, at equal steps of rank, and how many steps a window spans.
KNOTS, WINDOW = 41, 12


def rank_knots(rows: DataFrame, value: str, weight: str, knots: int = KNOTS) -> list[float]:
    """Values at equal steps of rank, from the least to the greatest, equal ones once.

    Each row knows from its running sum which steps fall on it, so this is one pass over ordered parts.
    """
    ranked = checkpoint(cumulated(rows.groupBy(value).agg(F.sum(weight).cast("long").alias("_n")), (value,), "_n", "_upto"))
    n = ranked.agg(F.max("_upto")).first()[0] or 0
    # Step j stands on place floor(j * (n - 1) / (knots - 1)); it is on this row if that is under _upto and not before it.
    steps = F.filter(F.sequence(F.lit(0), F.lit(knots - 1)), lambda j: (F.floor(j.cast("long") * (n - 1) / (knots - 1)) < F.col("_upto")) & (F.floor(j.cast("long") * (n - 1) / (knots - 1)) >= F.col("_upto") - F.col("_n")))
    found = ranked.select(F.col(value).alias("x"), F.explode(steps).alias("j")).orderBy("j").collect()  # a row per knot
    return [r["x"] for r in found]


def loess_offsets(counts: DataFrame, abundance: Column, files: Sequence[str], knots: int = KNOTS, window: int = WINDOW) -> DataFrame:
    """anchor_id, target_id and an offset per library: how its log counts depart, by abundance, from the mean of all.

    At knots of the abundance, lines are fitted to log counts (plus a half) with tricube weights over a window
    of ranks; between knots their values are interpolated, and the mean over libraries is taken off. Pairs
    with equal counts are one weighted row, and each knot's sums are added up in the tasks.
    """
    logs = [F.log(F.col(f"`{f}`") + 0.5).alias(f"_y{k}") for k, f in enumerate(files)]
    same = counts.withColumn("_x", abundance).groupBy("_x", *[F.col(f"`{f}`") for f in files]).agg(F.count("*").alias("_times"))
    rows = checkpoint(same.select("_x", "_times", *logs))
    at = rank_knots(rows, "_x", "_times", knots)
    if not at:
        return counts.select(*IDS, *[F.lit(0.0).alias(f) for f in files])
    lows = [min(max(j - window // 2, 0), max(knots - 1 - window, 0)) for j in range(knots)]
    reach = [max(at[j] - at[low], at[min(low + window, knots - 1)] - at[j]) for j, low in enumerate(lows)]
    # Of knots with one value the first counts.
    first = [j for j in range(len(at)) if not j or at[j] != at[j - 1]]
    places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(at[j])).alias("x"), F.lit(float(reach[j])).alias("h")) for j in first])
    near = F.filter(places, lambda k: F.abs(F.col("_x") - k["x"]) <= k["h"])
    each = rows.withColumn("_k", F.explode(near))
    d = F.col("_x") - F.col("_k.x")
    part = F.when(F.col("_k.h") > 0, F.pow(1 - F.pow(F.abs(d) / F.col("_k.h"), 3), 3)).otherwise(1.0)
    w = part * F.col("_times")
    sums = [F.sum(w).alias("w"), F.sum(w * d).alias("wd"), F.sum(w * d * d).alias("wdd")]
    sums += [x for k in range(len(files)) for x in (F.sum(w * F.col(f"_y{k}")).alias(f"wy{k}"), F.sum(w * d * F.col(f"_y{k}")).alias(f"wdy{k}"))]
    fits = each.groupBy(F.col("_k.j").alias("j")).agg(*sums).collect()  # a row per knot
    value: dict[float, list[float]] = {}
    for r in fits:
        flat = r["w"] * r["wdd"] - r["wd"] ** 2
        thin = flat <= 1e-12 * r["w"] * r["wdd"] or not r["wdd"]
        value[at[r["j"]]] = [r[f"wy{k}"] / r["w"] if thin else (r["wdd"] * r[f"wy{k}"] - r["wd"] * r[f"wdy{k}"]) / flat for k in range(len(files))]
    xs = sorted(value)
    lines = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.array(*[F.lit(float(v)) for v in value[x]]).alias("v")) for x in xs])
    placed = counts.withColumn("_x", abundance).withColumn("_lines", lines)
    under = F.greatest(F.size(F.filter("_lines", lambda k: k["x"] <= F.col("_x"))), F.lit(1))
    placed = placed.withColumn("_a", F.element_at("_lines", under)).withColumn("_b", F.element_at("_lines", F.least(under + 1, F.size("_lines"))))
    share = F.when(F.col("_b.x") > F.col("_a.x"), (F.col("_x") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))).otherwise(0.0)
    fitted = [F.col("_a.v")[k] + share * (F.col("_b.v")[k] - F.col("_a.v")[k]) for k in range(len(files))]
    mean = reduce(add, fitted) / len(files)
    return placed.select(*IDS, *[(x - mean).alias(f) for f, x in zip(files, fitted, strict=True)])


# --- negative binomial fits ---------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A design (a row per library, a column per coefficient) and the log offset of each library."""

    files: tuple[str, ...]
    design: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(design: DataFrame, totals: dict[str, int], factors: dict[str, float] | None = None) -> Model:
        """From a design table (file and a column per coefficient); offsets are logs of scaled totals."""
        rows = {r["file"]: r.asDict() for r in design.collect()}  # a row per library
        files = tuple(totals)
        names = [c for c in design.columns if c != "file"]
        matrix = np.array([[float(rows[f][c]) for c in names] for f in files])
        if np.linalg.matrix_rank(matrix) < len(names):
            raise ValueError("coefficients of the design depend on each other")
        return Model(files, matrix, np.log([totals[f] * (factors or {}).get(f, 1.0) for f in files]))

    def without(self, coefficient: int) -> Model:
        return Model(self.files, np.delete(self.design, coefficient, axis=1), self.offsets)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: recurrence up to 8, then the asymptotic series."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    up = x.copy()
    for _ in range(8):
        small = up < 8
        low = np.where(small, low + np.log(np.where(small, up, 1.0)), low)
        up = np.where(small, up + 1, up)
    inverse = 1 / (up * up)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / up
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + series - low


def deviances(y: np.ndarray, mu: np.ndarray, dispersion: float) -> np.ndarray:
    """Twice the log likelihood that a fit falls short of a perfect one, for each row."""
    ratio = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
    if dispersion == 0:
        return 2 * (ratio - (y - mu)).sum(1)
    return 2 * (ratio - (y + 1 / dispersion) * np.log((1 + dispersion * y) / (1 + dispersion * mu))).sum(1)


def fit_rows(y: np.ndarray, model: Model, dispersion: float, begin: np.ndarray | None = None, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, means and deviance of each row of counts: reweighted least squares for all rows at once.

    A step that makes the deviance of a row worse is halved. Coefficients of a row with nothing but zeros
    under them go towards minus infinity and stay where the deviance no longer changes.
    """
    x, off = model.design, model.offsets
    beta = begin if begin is not None else (np.log(y + 0.5) - off) @ np.linalg.pinv(x).T
    means = lambda b: np.exp(np.clip(b @ x.T + off, -60, 60))
    mu = means(beta)
    dev = deviances(y, mu, dispersion)
    ridge = 1e-10 * np.eye(x.shape[1])
    for _ in range(most_steps):
        weight = mu / (1 + dispersion * mu)
        slope = ((y - mu) / (1 + dispersion * mu)) @ x
        bend = np.einsum("ri,ij,ik->rjk", weight, x, x)
        step = np.linalg.solve(bend + ridge * np.maximum(np.trace(bend, axis1=1, axis2=2), 1e-300)[:, None, None], slope[:, :, None])[:, :, 0]
        size = np.ones(len(y))
        for _ in range(12):
            new = beta + size[:, None] * step
            new_mu = means(new)
            new_dev = deviances(y, new_mu, dispersion)
            worse = new_dev > dev + 1e-10 * (np.abs(dev) + 1)
            if not worse.any():
                break
            size[worse] /= 2
        gain = np.abs(dev - new_dev)
        moved = np.abs(step * slope).sum(1)
        beta, mu, dev = new, new_mu, new_dev
        if not ((gain > 1e-12 * (np.abs(dev) + 1)) | (moved > 1e-12)).any():
            break
    return beta, mu, dev


#: A direction in which a row of zeros lets coefficients go has no information in the end; it counts as this much.
LEAST_INFORMATION = 1e-3


def adjusted_profile(y: np.ndarray, model: Model, dispersion: float, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each row at its fit less half the log determinant of the information, and the fit."""
    beta, mu, _ = fit_rows(y, model, dispersion, begin)
    r = 1 / dispersion
    likelihood = (log_gamma(y + r) - log_gamma(np.array(r)) - log_gamma(y + 1) - r * np.log1p(mu * dispersion) + y * (np.log(mu) - np.log(r + mu))).sum(1)
    bend = np.einsum("ri,ij,ik->rjk", mu / (1 + dispersion * mu), model.design, model.design)
    return likelihood - 0.5 * np.log(np.maximum(np.linalg.eigvalsh(bend), LEAST_INFORMATION)).sum(1), beta


#: Rows that are fitted at once.
BATCH_ROWS = 8192


def _count_batches(batches: Iterator[pa.RecordBatch], files: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(k, BATCH_ROWS)
            y = np.stack([part.column(part.schema.get_field_index(f)).to_numpy(zero_copy_only=False).astype(np.float64) for f in files], 1)
            yield part, y


def grid_likelihoods(counts: DataFrame, model: Model, grid: Sequence[float]) -> dict[float, float]:
    """Adjusted profile log likelihood of all pairs at each dispersion of a grid: one pass over the pairs.

    Each fit begins where that of the dispersion before ended. A task sends one row per dispersion. Pairs
    with equal counts are fitted once; those without a count say nothing.
    """
    files = model.files
    once = counts.where(reduce(add, [F.col(f"`{f}`") for f in files]) > 0).groupBy(*[F.col(f"`{f}`") for f in files]).agg(F.count("*").alias("_times"))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for part, y in _count_batches(batches, files):
            times, begin = part.column(part.schema.get_field_index("_times")).to_numpy(), None
            for k, dispersion in enumerate(grid):
                value, begin = adjusted_profile(y, model, dispersion, begin)
                total[k] += float(value @ times)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total)], ["k", "value"])

    sums = once.mapInArrow(likelihoods, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()  # a row per dispersion
    return {grid[r["k"]]: r["value"] for r in sums}


def common_dispersion(counts: DataFrame, model: Model, lowest: float = 1e-4, highest: float = 4.0, points: int = 9, rounds: int = 4) -> float:
    """The dispersion under which all pairs together are likeliest: grids of logs, each around the best of the last."""
    low, high = math.log(lowest), math.log(highest)
    best = low
    for _ in range(rounds):
        grid = [math.exp(x) for x in np.linspace(low, high, points)]
        found = grid_likelihoods(counts, model, grid)
        if not found:
            return lowest
        k = max(range(points), key=lambda k: found[grid[k]])
        best, step = math.log(grid[k]), (high - low) / (points - 1)
        if 0 < k < points - 1:
            # The top of the parabola through the three values around the best.
            a, b, c = (found[grid[k + d]] for d in (-1, 0, 1))
            if a - 2 * b + c < 0:
                best += step * (a - c) / (2 * (a - 2 * b + c))
        low, high = max(math.log(lowest), best - step), min(math.log(highest), best + step)
    return math.exp(best)


def chi_square_tail(x: np.ndarray, df: int) -> np.ndarray:
    """Probability of more than x with so many degrees of freedom: closed forms and their recurrence."""
    half = np.maximum(x, 0) / 2
    a = 0.5 if df % 2 else 1.0
    out = np.array([math.erfc(math.sqrt(h)) for h in half]) if df % 2 else np.exp(-half)
    while a < df / 2:
        out = out + np.exp(a * np.log(np.maximum(half, 1e-300)) - half - math.lgamma(a + 1))
        a += 1
    return out


def fit_models(counts: DataFrame, model: Model, dispersion: float) -> DataFrame:
    """anchor_id, target_id, coefficients (natural logs) and deviance of each pair's fit. No shuffle."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y in _count_batches(batches, model.files):
            beta, _, dev = fit_rows(y, model, dispersion)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in IDS), pa.array(list(beta)), pa.array(dev)], [*IDS, "coefficients", "deviance"])

    rows = counts.select(*[F.col(c).cast("long").alias(c) for c in IDS], *[F.col(f"`{f}`").cast("double").alias(f) for f in model.files])
    return rows.mapInArrow(fit, "anchor_id long, target_id long, coefficients array<double>, deviance double")


def coefficient_test(counts: DataFrame, model: Model, coefficient: int, dispersion: float) -> DataFrame:
    """anchor_id, target_id, log_fold (log2), ratio (twice the log likelihood ratio) and pvalue of one coefficient.

    Both fits of a pair are made in one pass; `stats.bh_adjust` takes it from there.
    """
    less = model.without(coefficient)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y in _count_batches(batches, model.files):
            beta, _, full = fit_rows(y, model, dispersion)
            ratio = np.maximum(fit_rows(y, less, dispersion)[2] - full, 0)
            columns = [*(part.column(part.schema.get_field_index(c)) for c in IDS), pa.array(beta[:, coefficient] / math.log(2)), pa.array(ratio), pa.array(chi_square_tail(ratio, 1))]
            yield pa.RecordBatch.from_arrays(columns, [*IDS, "log_fold", "ratio", "pvalue"])

    rows = counts.select(*[F.col(c).cast("long").alias(c) for c in IDS], *[F.col(f"`{f}`").cast("double").alias(f) for f in model.files])
    return rows.mapInArrow(judge, "anchor_id long, target_id long, log_fold double, ratio double, pvalue double")
