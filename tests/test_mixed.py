import math

import numpy as np
import pytest

from plinth.operators import mixed
from plinth.sources.io import ContractError


def test_log_gamma():
    for x in (1e-3, 0.5, 1.0, 7.3, 1e5):
        assert mixed.log_gamma(np.array(x)) == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)


def simulate(spark, family, seed=1, groups=250, each=8):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        u = rng.normal(0, 0.8)
        for _ in range(each):
            x = float(rng.integers(0, 2))
            eta = 0.3 + 0.7 * x + u
            if family == "binomial":
                y = float(rng.random() < 1 / (1 + math.exp(-eta)))
            else:
                mu = math.exp(eta + 0.5)
                y = float(rng.poisson(rng.gamma(3.0, mu / 3.0)))
            rows.append((f"g{g}", x, y))
    return spark.createDataFrame(rows, "g string, x double, y double")


def test_binomial_recovers_its_parameters(spark):
    df = simulate(spark, "binomial")
    fit = mixed.fit_mixed(df, "y", ["x"], "g")
    mixed.mixed_gate(fit)
    assert abs(fit["coefficients"][1] - 0.7) < 3 * fit["errors"][1] and abs(fit["sd"] - 0.8) < 0.25
    null = mixed.fit_mixed(df, "y", [], "g")
    chi2, k, p = mixed.likelihood_ratio(null, fit)
    assert k == 1 and chi2 > 10 and p < 0.01 and 0 < mixed.intraclass(fit) < 1


def test_negative_binomial_recovers_its_parameters(spark):
    fit = mixed.fit_mixed(simulate(spark, "negative_binomial"), "y", ["x"], "g", "negative_binomial")
    mixed.mixed_gate(fit)
    assert abs(fit["coefficients"][1] - 0.7) < 3 * fit["errors"][1]
    assert abs(fit["sd"] - 0.8) < 0.25 and 1.5 < fit["theta"] < 6


def test_gate_refuses():
    with pytest.raises(ContractError):
        mixed.mixed_gate({"converged": True, "positive_definite": True, "sd": 1e-6})


def test_negative_binomial_by_maximum_likelihood(spark):
    import math

    import numpy as np
    from pyspark.sql import functions as F

    from plinth.operators import stats

    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, 600)
    y = rng.poisson(rng.gamma(2.5, np.exp(1.0 + 0.4 * x) / 2.5))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    fit = stats.fit_negative_binomial(df, "y", ["x"])
    assert fit["converged"] and fit["coefficients"][0] == pytest.approx(math.log(y[x == 0].mean()), abs=1e-6)

    def log_l(theta):
        mu = np.where(x == 1, y[x == 1].mean(), y[x == 0].mean())
        return sum(math.lgamma(a + theta) - math.lgamma(theta) - math.lgamma(a + 1) + theta * math.log(theta / (theta + m)) + a * math.log(m / (theta + m)) for a, m in zip(y.tolist(), mu.tolist()))

    grid = np.exp(np.linspace(-2, 4, 2000))
    best = max(grid, key=log_l)
    assert fit["theta"] == pytest.approx(best, rel=0.01) and fit["log_likelihood"] >= log_l(best) - 1e-6
    flat = spark.createDataFrame([(0, 3)] * 50 + [(1, 3)] * 50, "x int, y int")
    assert stats.fit_negative_binomial(flat, "y", ["x"])["theta"] > 1e5
    got = spark.range(1, 40).select("id", stats.log_gamma(F.col("id") / 4).alias("a"), stats.digamma(F.col("id") / 4).alias("b"), stats.trigamma(F.col("id") / 4).alias("c")).collect()
    h = 1e-4
    for r in got:
        v = r.id / 4
        assert r.a == pytest.approx(math.lgamma(v), abs=1e-9)
        assert r.b == pytest.approx((math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h), abs=1e-5)
        assert r.c == pytest.approx((math.lgamma(v + h) - 2 * math.lgamma(v) + math.lgamma(v - h)) / h**2, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("family", ["binomial", "negative_binomial"])
@pytest.mark.parametrize("piece", [3, 50_000])
def test_groups_are_finished_where_they_lie(spark, monkeypatch, family, piece):
    """Equal to the sum over all groups done by hand, with groups in pieces and across batches; whole groups are not shuffled."""
    monkeypatch.setattr(mixed, "PIECE", piece)
    rows = [(r.g, r.y, [1.0, r.x]) for r in simulate(spark, family, groups=40, each=15).collect()]
    held = mixed.dealt(spark.createDataFrame(rows, "g string, y double, x array<double>").repartition(5))
    assert held.count() < len(rows) and held.where("large").isEmpty() == (piece > 3)
    vectors = np.array([[0.2, 0.6, -0.3, 0.9], [-0.1, 0.4, 0.2, 0.1]])
    at, weight = np.polynomial.hermite_e.hermegauss(5)
    want = []
    for v in vectors:
        theta, by = math.exp(v[3]), {}
        for g, y, x in rows:
            eta = v[0] + v[1] * x[1] + math.exp(v[2]) * at
            mu = np.exp(eta)
            nb = math.lgamma(y + theta) - math.lgamma(theta) - math.lgamma(y + 1) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))
            by[g] = by.get(g, 0) + (y * eta - np.log1p(np.exp(eta)) if family == "binomial" else nb)
        want.append(sum(math.log((weight / math.sqrt(2 * math.pi) * np.exp(s)).sum()) for s in by.values()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert mixed.log_likelihoods(held, vectors, 2, family, 5) == pytest.approx(want, rel=1e-10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
