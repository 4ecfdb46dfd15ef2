import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import batch, residuals


def test_distribution_functions_equal_sums(spark):
    rows = [(k, mu, th) for k in (-1, 0, 1, 3, 20, 150) for mu in (1e-3, 0.4, 3.0, 25.0, 140.0) for th in (0.05, 1.0, 7.5, 400.0)] + [(None, 1.0, 1.0), (2, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, mu double, th double")
    got = df.select("*", residuals.poisson_cdf(F.col("k"), F.col("mu")).alias("p"), residuals.negative_binomial_cdf(F.col("k"), F.col("mu"), F.col("th")).alias("nb")).collect()
    for r in got:
        if r.k is None or r.mu is None:
            assert r.p is None and r.nb is None
            continue
        p = math.fsum(math.exp(j * math.log(r.mu) - r.mu - math.lgamma(j + 1)) for j in range(r.k + 1))
        nb = math.fsum(math.exp(math.lgamma(j + r.th) - math.lgamma(r.th) - math.lgamma(j + 1) + r.th * math.log(r.th / (r.th + r.mu)) + j * math.log(r.mu / (r.th + r.mu))) for j in range(r.k + 1))
        assert r.p == pytest.approx(p, abs=1e-10) and r.nb == pytest.approx(nb, abs=1e-10)


def test_incomplete_functions_at_their_ends():
    assert residuals.beta_lower([2.0, 2.0, 2.0], [3.0, 3.0, 3.0], [0.0, 1.0, 0.5]).tolist() == pytest.approx([0, 1, 0.6875])
    assert residuals.gamma_upper([1.0, 1.0, 5e4], [0.0, 700.0, 5e4]).tolist() == pytest.approx([1, 0, 0.4994], abs=1e-4)
    assert residuals.beta_lower([3e4], [2e4], [0.6])[0] == pytest.approx(0.5, abs=1e-2)
    assert len(residuals.gamma_upper([], [])) == 0


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=3000)
    mu = np.exp(0.7 + 0.4 * x)
    return spark.createDataFrame([(i, float(a), int(p), int(n)) for i, (a, p, n) in enumerate(zip(x, rng.poisson(mu), rng.poisson(rng.gamma(0.8, mu / 0.8))))] + [(3000, None, 3, 3), (3001, 1.0, None, None)], "i long, x double, p int, n int").checkpoint()


def test_the_right_model_passes_and_the_wrong_one_does_not(counts):
    of = lambda family, y: {r.test: r for r in residuals.residual_tests(counts, batch.fit_one(counts, y, ["x"], family), y, ["i"], 1).collect()}
    for family, y in (("poisson", "p"), ("negative_binomial", "n")):
        right = of(family, y)
        assert all(r.p_value > 0.01 and r.n == 3000 for r in right.values()) and right["dispersion"].statistic == pytest.approx(1, abs=0.1)
    wrong = of("poisson", "n")
    assert all(r.p_value < 1e-6 for r in wrong.values()) and wrong["dispersion"].statistic > 1.5 and wrong["zeros"].statistic > 1.3


def test_residuals_lie_between_the_steps_and_do_not_move(counts):
    fit = batch.fit_one(counts, "p", ["x"], "poisson")
    rows = residuals.quantile_residuals(counts, fit, "p", ["i"], 5)
    a, b = rows.orderBy("i").collect(), residuals.quantile_residuals(counts.repartition(7), fit, "p", ["i"], 5).orderBy("i").collect()
    assert [r.residual for r in a] == [r.residual for r in b] and a[3000].residual is None and a[3001].residual is None
    for r in a[:200]:
        low = math.fsum(math.exp(j * math.log(r.mu) - r.mu - math.lgamma(j + 1)) for j in range(r.p))
        assert low - 1e-9 <= r.residual <= low + math.exp(r.p * math.log(r.mu) - r.mu - math.lgamma(r.p + 1)) + 1e-9
    with pytest.raises(ValueError):
        residuals.quantile_residuals(counts, {**fit, "family": "gaussian"}, "p", ["i"])
