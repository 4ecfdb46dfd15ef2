import math

import numpy as np
import pytest

from plinth.operators import stats
from plinth.sources.io import ContractError


def test_natural_spline_is_linear_outside_its_knots_and_smooth_inside(spark):
    knots = [2.0, 5.0, 9.0, 14.0]
    terms = stats.spline_terms("x", knots)
    assert list(terms) == ["x_s1", "x_s2", "x_s3"]
    xs = [round(-3 + 0.5 * i, 1) for i in range(50)] + [None]
    got = {r["x"]: [r[c] for c in terms] for r in spark.createDataFrame([(x,) for x in xs], "x double").withColumns(terms).collect()}
    assert got[None] == [None, None, None] and got[1.0][1:] == [0.0, 0.0]
    above = lambda x, k: max(x - k, 0.0) ** 3
    d = lambda x, k: (above(x, k) - above(x, 14.0)) / (14.0 - k) / 12.0
    for x in xs[:-1]:
        assert got[x] == pytest.approx([x, d(x, 2.0) - d(x, 9.0), d(x, 5.0) - d(x, 9.0)], abs=1e-9)
    for j in (1, 2):  # second differences vanish beyond the last knot
        assert got[16.0][j] - 2 * got[17.0][j] + got[18.0][j] == pytest.approx(0, abs=1e-8)


def test_spline_fit_finds_a_curve_and_refuses_two_values(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 3000)
    y = rng.normal(np.sin(x / 8.0), 0.1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    rows, fit = stats.fit_spline(df, "y", "x", family="gaussian", knots=[1.0, 8.0, 16.0, 24.0, 32.0, 38.0])
    seen = {r["x"]: r["p"] for r in stats.predict(rows, fit, "p").collect()}
    assert fit["n"] == 3000 and seen.pop(None) is None
    assert max(abs(p - math.sin(a / 8.0)) for a, p in seen.items()) < 0.08
    with pytest.raises(ContractError):
        stats.fit_spline(df.where("x in (1, 2)"), "y", "x", family="gaussian")


def test_zero_inflated_recovers_its_parameters_and_beats_poisson(spark):
    rng = np.random.default_rng(5)
    arm = rng.integers(0, 2, 6000)
    y = np.where(rng.random(6000) < 0.3, 0, rng.poisson(np.exp(0.6 + 0.5 * arm)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(arm, y)] + [(None, 3.0)], "arm double, y double")
    fit = stats.fit_zero_inflated(df, "y", ["arm"])
    assert fit["converged"] and fit["positive_definite"] and fit["n"] == 6000
    assert fit["coefficients"] == pytest.approx([0.6, 0.5], abs=0.1) and fit["extra_zeros"] == pytest.approx(0.3, abs=0.04)
    assert 2 * (fit["log_likelihood"] - fit["poisson_log_likelihood"]) > 100
    # the likelihood, written out for one row after the other, is highest there
    def log_l(b0, b1, pi):
        mu = np.exp(b0 + b1 * arm)
        return float(np.where(y == 0, np.log(pi + (1 - pi) * np.exp(-mu)), math.log(1 - pi) + y * np.log(mu) - mu - np.array([math.lgamma(k + 1) for k in y])).sum())

    at = [*fit["coefficients"], fit["extra_zeros"]]
    assert log_l(*at) == pytest.approx(fit["log_likelihood"], rel=1e-9)
    for i in range(3):
        for off in (-0.01, 0.01):
            assert log_l(*[v + off * (i == j) for j, v in enumerate(at)]) < fit["log_likelihood"]


def test_zero_inflated_without_extra_zeros_is_poisson(spark):
    y = np.random.default_rng(9).binomial(4, 0.4, 2000)
    fit = stats.fit_zero_inflated(spark.createDataFrame([(float(v),) for v in y], "y double"), "y")
    assert fit["converged"] and fit["extra_zeros"] < 1e-3
    assert fit["log_likelihood"] == pytest.approx(fit["poisson_log_likelihood"], abs=0.01)
