import math

import numpy as np
import pytest

from plinth.operators import crossed, graph
from plinth.sources.io import ContractError


def test_components_of_chains_stars_and_loops(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(60)]
    star = [("s0", f"s{i}") for i in range(1, 40)]
    rows = [*chain, *star, ("x", "x"), ("y", None), ("p", "q"), ("q", "p"), ("p", "q")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(rows, "u string, v string")).collect()}
    assert got == {**{f"c{i}": "c0" for i in range(61)}, **{f"s{i}": "s0" for i in range(40)}, "x": "x", "p": "p", "q": "p"}
    assert graph.components(spark.createDataFrame([], "u string, v string")).collect() == []


def dense(rows, x, beta, sds, family, theta):
    """Laplace over the whole table at once."""
    a, b = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    z = np.zeros((len(rows), len(a) + len(b)))
    for i, r in enumerate(rows):
        z[i, a.index(r[0])] = z[i, len(a) + b.index(r[1])] = 1
    y, sd = np.array([r[-1] for r in rows]), np.repeat(sds, [len(a), len(b)])
    u = np.zeros(z.shape[1])
    for _ in range(200):
        eta = x @ beta + z @ u
        _, slope, bend = crossed.row_terms(y, eta, family, theta)
        info = (z * bend[:, None]).T @ z + np.diag(1 / sd**2)
        u = u + np.clip(np.linalg.solve(info, z.T @ slope - u / sd**2), -0.5, 0.5)
    eta = x @ beta + z @ u
    mu = np.exp(eta)
    if family == "binomial":
        log_l = sum(math.log(1 / (1 + math.exp(-e))) if v else math.log(1 / (1 + math.exp(e))) for v, e in zip(y, eta))
    elif family == "poisson":
        log_l = sum(v * math.log(m) - m - math.lgamma(v + 1) for v, m in zip(y, mu))
    else:
        log_l = sum(math.lgamma(v + theta) - math.lgamma(theta) - math.lgamma(v + 1) + theta * math.log(theta / (theta + m)) + v * math.log(m / (theta + m)) for v, m in zip(y, mu))
    _, _, bend = crossed.row_terms(y, eta, family, theta)
    info = (z * bend[:, None]).T @ z + np.diag(1 / sd**2)
    return log_l - 0.5 * (u**2 / sd**2).sum() - 0.5 * np.linalg.slogdet(info)[1] - np.log(sd).sum()


def made(seed, pairs, each, calls, sds, family, nested=True, theta=2.0):
    rng = np.random.default_rng(seed)
    u, rows = rng.normal(0, sds[0], pairs), []
    v = rng.normal(0, sds[1], pairs * each)
    for i in range(pairs):
        for j in range(each):
            who = i * each + j if nested else (i * 3 + j) % (pairs // 2)
            for _ in range(calls):
                x = float(rng.integers(0, 2))
                eta = 0.5 + 0.8 * x + u[i] + v[who]
                y = float(rng.random() < 1 / (1 + math.exp(-eta))) if family == "binomial" else float(rng.poisson(math.exp(eta) * (rng.gamma(theta) / theta if family == "negative_binomial" else 1)))
                rows.append((f"p{i}", f"n{who}", x, y))
    return rows


KIND = "pair string, npi string, x double, y double"


@pytest.mark.parametrize("family,nested", [("binomial", True), ("poisson", False), ("negative_binomial", False), ("negative_binomial", True)])
def test_likelihood_equals_the_dense_one(spark, family, nested):
    rows = made(3, 10, 2, 3, (0.7, 0.5), family, nested)
    df = spark.createDataFrame([*rows, ("p0", None, 1.0, 1.0), ("p1", "n1", None, 1.0)], KIND)
    held = crossed.gathered(df.repartition(3), "y", ["x"], "pair", "npi", 100, 1000)
    assert held.count() == (10 if nested else 1)
    x = np.array([[1.0, r[2]] for r in rows])
    vectors = np.array([[0.4, 0.9, math.log(0.7), math.log(0.5), math.log(2.0)], [0.1, -0.2, math.log(1.5), math.log(0.05), math.log(0.6)], [0.5, 0.8, math.log(1e-3), math.log(2.0), math.log(30.0)]])
    vectors = vectors if family == "negative_binomial" else vectors[:, :4]
    got = crossed.log_likelihoods(held, vectors, 2, family)
    want = [dense(rows, x, v[:2], np.exp(v[2:4]), family, math.exp(v[4]) if len(v) > 4 else 1.0) for v in vectors]
    assert got == pytest.approx(want, abs=1e-6)


def test_planted_values_are_found_again(spark):
    df = spark.createDataFrame(made(5, 150, 2, 6, (0.9, 0.5), "poisson"), KIND).checkpoint()
    fit = crossed.fit_crossed(df, "y", ["x"], "pair", "npi", "poisson")
    assert fit["converged"] and fit["positive_definite"] and not any(fit["at_bound"])
    assert abs(fit["coefficients"][1] - 0.8) < 4 * fit["errors"][1] and abs(fit["sds"][0] - 0.9) < 0.2 and abs(fit["sds"][1] - 0.5) < 0.15
    at = [*fit["coefficients"], *np.log(fit["sds"])]
    held = crossed.gathered(df, "y", ["x"], "pair", "npi", 100, 1000)
    around = crossed.log_likelihoods(held, np.array([at, *[np.array(at) + s * 0.03 * e for e in np.eye(4) for s in (-1, 1)]]), 2, "poisson")
    assert around[0] == pytest.approx(fit["log_likelihood"]) and (around[1:] < around[0]).all()
    parts = {r.factor: r for r in crossed.intercept_components(df, fit, "y").collect()}
    assert parts["pair"].variance == pytest.approx(fit["sds"][0] ** 2) and sum(r.icc for r in parts.values()) == pytest.approx(1)
    assert set(parts) == {"pair", "npi", "residual"} and parts["pair"].icc > parts["npi"].icc > 0


def test_no_variance_and_bounds(spark):
    flat = made(6, 60, 2, 4, (0.0, 0.0), "binomial")
    fit = crossed.fit_crossed(spark.createDataFrame(flat, KIND), "y", ["x"], "pair", "npi")
    assert fit["converged"] and min(fit["sds"]) < 0.4 and abs(fit["coefficients"][1] - 0.8) < 4 * fit["errors"][1]
    with pytest.raises(ContractError, match="solved densely"):
        crossed.fit_crossed(spark.createDataFrame(flat, KIND), "y", ["x"], "pair", "npi", most_groups=2)
    with pytest.raises(ContractError, match="no complete rows"):
        crossed.fit_crossed(spark.createDataFrame([], KIND), "y", ["x"], "pair", "npi")
    with pytest.raises(ValueError):
        crossed.fit_crossed(spark.createDataFrame(flat, KIND), "y", ["x"], "pair", "npi", "gaussian")


def test_nested_groups_need_no_dense_algebra_and_no_search_for_components(spark, monkeypatch):
    """A pair with many clinicians, either factor outside, and equal rows counted once."""
    rows = made(8, 3, 60, 5, (0.7, 0.5), "poisson")
    monkeypatch.setattr(crossed, "components", None)
    monkeypatch.setattr(crossed, "laplace", None)
    x, vector = np.array([[1.0, r[2]] for r in rows]), np.array([0.4, 0.9, math.log(0.7), math.log(0.4)])
    want = dense(rows, x, vector[:2], np.exp(vector[2:]), "poisson", 1.0)
    df = spark.createDataFrame(rows, KIND)
    for first, second, own in (("pair", "npi", vector), ("npi", "pair", vector[[0, 1, 3, 2]])):
        held = crossed.gathered(df, "y", ["x"], first, second, 100, 1000)
        assert held.count() == 3 and sum(len(r.y) for r in held.collect()) < len(rows)
        assert crossed.log_likelihoods(held, own[None, :], 2, "poisson")[0] == pytest.approx(want, abs=1e-6)
