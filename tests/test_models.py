"""Count models against plain optimisers and local fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagplane.operators import models, stats

FILES = ("a", "b", "c", "d")
TOTALS = {"a": 10_000, "b": 14_000, "c": 9_000, "d": 20_000}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    mean = np.exp(rng.uniform(0, 5, 120))[:, None] * np.array([TOTALS[f] for f in FILES]) / 10_000 * np.where(rng.random(120) < 0.3, 3, 1)[:, None] ** np.array([0, 1, 0, 1])
    return rng.negative_binomial(1 / 0.15, 1 / (1 + 0.15 * mean))


@pytest.fixture(scope="module")
def counts(spark, rows):
    return spark.createDataFrame([(i, i // 2, *map(int, r)) for i, r in enumerate(rows)], "anchor_id long, target_id long, a int, b int, c int, d int")


@pytest.fixture(scope="module")
def model():
    return models.Model(FILES, np.array([[1, 0, 0], [1, 0, 1], [1, 1, 0], [1, 1, 1]], float), np.log([TOTALS[f] for f in FILES]))


def likelihood(y, mu, phi):
    r = 1 / phi
    return sum(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + m)) + k * math.log(m / (r + m)) for k, m in zip(y, mu, strict=True))


def test_abundance_equals_bisection(counts, rows):
    mean = sum(TOTALS.values()) / 4
    more = np.array([2 * t / mean for t in TOTALS.values()])
    size = np.array(list(TOTALS.values())) + 2 * more
    for phi in (0.0, 0.05, 3.0):
        got = {r["anchor_id"]: r["ave_log_cpm"] for r in models.fitted_log_cpm(counts, TOTALS, phi).collect()}
        for i, y in enumerate(rows + more):
            lo, hi = -40.0, 5.0
            for _ in range(90):
                m = (lo + hi) / 2
                mu = size * math.exp(m)
                lo, hi = (m, hi) if ((y - mu) / (1 + phi * mu)).sum() > 0 else (lo, m)
            assert got[i] == pytest.approx((lo + math.log(1e6)) / math.log(2), abs=1e-8)


def test_coefficients_are_where_the_likelihood_is_greatest(counts, rows, model):
    phi = 0.2
    got = {r["anchor_id"]: r for r in models.fit_models(counts, model, phi).collect()}
    for i, y in enumerate(rows):
        beta = np.array(got[i]["coefficients"])
        at = lambda b: likelihood(y, np.exp(model.design @ b + model.offsets), phi)  # noqa: B023, E731
        if (y == 0).any():
            continue
        top = at(beta)
        # A plain search around it finds nothing better, and the slope is flat in every direction.
        for k in range(3):
            for h in (1e-4, 1e-2, 0.5):
                e = np.eye(3)[k] * h
                assert at(beta + e) <= top + 1e-9 and at(beta - e) <= top + 1e-9
            assert abs(at(beta + np.eye(3)[k] * 1e-5) - at(beta - np.eye(3)[k] * 1e-5)) / 2e-5 < 1e-4
        perfect = likelihood(y, np.maximum(y, 1e-12), phi)
        assert got[i]["deviance"] == pytest.approx(2 * (perfect - top), abs=1e-6)


def test_dispersion_is_where_the_profile_is_greatest(counts, rows, model):
    found = models.common_dispersion(counts, model)
    y = rows[rows.sum(1) > 0].astype(float)
    at = lambda phi: float(models.adjusted_profile(y, model, phi)[0].sum())
    assert 0.05 < found < 0.5
    assert all(at(found) >= at(found * s) - 1e-3 for s in (0.5, 0.9, 0.99, 1.01, 1.1, 2))
    mu = models.fit_rows(y, model, found)[1]
    info = [np.log(np.maximum(np.linalg.eigvalsh(model.design.T @ np.diag(m / (1 + found * m)) @ model.design), models.LEAST_INFORMATION)).sum() for m in mu]
    plain = sum(likelihood(k, m, found) - 0.5 * d for k, m, d in zip(y, mu, info, strict=True))
    assert models.grid_likelihoods(counts, model, [found])[found] == pytest.approx(plain, rel=1e-8)
    assert models.common_dispersion(counts.limit(0), model) == 1e-4


def test_tests_and_tails(spark, counts, rows, model):
    got = {r["anchor_id"]: r for r in models.coefficient_test(counts, model, 2, 0.15).collect()}
    less = model.without(2)
    for i, y in enumerate(rows):
        mu1, mu0 = (models.fit_rows(y[None].astype(float), m, 0.15)[1][0] for m in (model, less))
        ratio = 2 * (likelihood(y, np.maximum(mu1, 1e-300), 0.15) - likelihood(y, np.maximum(mu0, 1e-300), 0.15))
        assert got[i]["ratio"] == pytest.approx(max(ratio, 0), abs=1e-5)
        assert got[i]["pvalue"] == pytest.approx(math.erfc(math.sqrt(got[i]["ratio"] / 2)))
    assert min(r["pvalue"] for r in got.values()) < 1e-4
    # Tails of 1 to 5 degrees of freedom against summed densities.
    for df in range(1, 6):
        x = np.linspace(2.0, 200, 400_001)
        density = x ** (df / 2 - 1) * np.exp(-x / 2) / 2 ** (df / 2) / math.gamma(df / 2)
        assert models.chi_square_tail(np.array([2.0]), df)[0] == pytest.approx(np.trapezoid(density, x), rel=1e-5)
    zeros = spark.createDataFrame([(1, 1, 0, 0, 0, 0), (2, 1, 5, 0, 0, 0)], counts.schema)
    assert all(math.isfinite(r["ratio"]) and 0 <= r["pvalue"] <= 1 for r in models.coefficient_test(zeros, model, 2, 0.1).collect())
    with pytest.raises(ValueError):
        models.Model.of(spark.createDataFrame([(f, 1, 1) for f in FILES], "file string, x int, y int"), TOTALS)


def test_offsets_equal_a_plain_local_fit(spark, counts, rows):
    got = {r["anchor_id"]: [r[f] for f in FILES] for r in models.loess_offsets(counts, stats.log_mean(TOTALS), FILES).collect()}
    x = {r["anchor_id"]: r["x"] for r in counts.select("anchor_id", stats.log_mean(TOTALS).alias("x")).collect()}
    xs = np.array([x[i] for i in range(len(rows))])
    ranked, n, last = np.sort(xs), len(xs), models.KNOTS - 1
    at = [ranked[j * (n - 1) // last] for j in range(models.KNOTS)]
    fits = {}
    for j, k in enumerate(at):
        low = min(max(j - models.WINDOW // 2, 0), last - models.WINDOW)
        h = max(k - at[low], at[low + models.WINDOW] - k)
        w = np.where(np.abs(xs - k) <= h, (1 - np.minimum(np.abs(xs - k) / h, 1) ** 3) ** 3, 0)
        fits.setdefault(k, [np.polyfit(xs - k, np.log(rows[:, f] + 0.5), 1, w=np.sqrt(w))[1] for f in range(4)])
    ks = sorted(fits)
    fitted = np.array([np.interp(xs, ks, [fits[k][f] for k in ks]) for f in range(4)])
    expected = fitted - fitted.mean(0)
    for i in range(n):
        assert got[i] == pytest.approx(expected[:, i].tolist(), abs=1e-6)
    same = spark.createDataFrame([(k, 1, 5, 5, 5, 5) for k in range(7)], counts.schema)
    assert all(abs(r[f]) < 1e-12 for r in models.loess_offsets(same, F.lit(1.0), FILES).collect() for f in FILES)
    assert models.loess_offsets(counts.limit(0), F.lit(1.0), FILES).count() == 0
