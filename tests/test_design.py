import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import design, stats
from plinth.operators.batch import fit_one
from plinth.sources.io import ContractError

ARMS, SITES = ["a.1", "b", "c"], ["x", "y"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1200):
        arm, site, z = ARMS[int(rng.integers(0, 3))], SITES[int(rng.integers(0, 2))], float(rng.normal())
        eta = 0.4 + 0.3 * z + 0.5 * (arm == "b") - 0.4 * (arm == "c") + 0.6 * (arm == "c" and site == "y")
        u = 0.3 * float(rng.normal())
        rows.append((i // 4, arm if i % 60 else None, site, z, float(rng.poisson(math.exp(eta + u))), float(rng.random() < 1 / (1 + math.exp(-eta))), eta + float(rng.normal())))
    return spark.createDataFrame(rows, "g long, arm string, site string, z double, n double, y double, v double").checkpoint()


def dense(table):
    rows = [r for r in table.collect() if r.arm]
    x = np.array([[1, r.z, r.arm == "b", r.arm == "c", r.site == "y", r.arm == "b" and r.site == "y", r.arm == "c" and r.site == "y"] for r in rows], float)
    return rows, x


TERMS = ["z", "arm", "site", ("arm", "site")]


def test_columns_levels_and_least_squares(table):
    made = design.model_matrix(table, TERMS, ["arm", "site"])
    assert made.names == ["z", "arm=b", "arm=c", "site=y", "arm=b:site=y", "arm=c:site=y"] and not made.dropped
    assert made.levels == {"arm": ("a.1", "b", "c"), "site": ("x", "y")}
    fit = design.fit_design(table, "v", made)
    rows, x = dense(table)
    y = np.array([r.v for r in rows])
    b, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    v = np.linalg.inv(x.T @ x) * rss[0] / (len(y) - 7)
    assert fit["n"] == len(rows) == 1180 and fit["coefficients"] == pytest.approx(b.tolist(), abs=1e-9)
    assert np.allclose(fit["covariance"], v, rtol=1e-8) and made.apply(table.where("arm is null")).select("`arm=b`").first()[0] is None


def test_aliased_columns_go_and_unseen_levels_stop(table, spark):
    more = table.withColumn("z2", F.col("z") * 2 - 1).withColumn("both", F.concat("arm", "site")).withColumn("flat", F.lit(3.0))
    made = design.model_matrix(more, ["z", "flat", "z2", "arm", "both", ("arm", "z2")], ["arm", "both"])
    assert made.dropped[:2] == ("flat", "z2") and len(made.names) == 1 + 2 + 3 + 2
    fit = design.fit_design(more, "v", made)
    assert fit["converged"] and fit["positive_definite"]
    empty = more.where("not (arm = 'c' and site = 'y')")
    assert design.model_matrix(empty, TERMS, ["arm", "site"]).dropped == ("arm=c:site=y",)
    small = design.model_matrix(table.where("arm <> 'c'"), ["arm"], ["arm"])
    with pytest.raises(Exception, match="unseen level of arm"):
        small.apply(table).agg(F.sum("`arm=b`")).collect()
    with pytest.raises(ContractError, match="more than 10 levels"):
        design.model_matrix(table, ["g"], ["g"], most_levels=10)
    with pytest.raises(ContractError, match="no level"):
        design.model_matrix(table.where("arm is null"), ["arm"], ["arm"])
    with pytest.raises(ContractError):
        design.model_matrix(table.where("false"), ["z"])


def test_interaction_is_found(table):
    made = design.model_matrix(table, TERMS, ["arm", "site"])
    rows = made.apply(table)
    large, small = fit_one(rows, "n", made.names, "poisson"), fit_one(rows, "n", made.names[:4], "poisson")
    r = stats.nested_test(rows, small, large, "n").first()
    assert r.df == 2 and r.p_value < 1e-4


def test_marginal_means_and_contrasts(table):
    made = design.model_matrix(table, TERMS, ["arm", "site"])
    rows, x = dense(table)
    for family, y in (("poisson", "n"), ("binomial", "y"), ("gaussian", "v")):
        fit = design.fit_design(table, y, made, family)
        v, b = np.array(fit["covariance"]), np.array(fit["coefficients"])
        mean = {"poisson": np.exp, "binomial": lambda e: 1 / (1 + np.exp(-e)), "gaussian": lambda e: e}[family]
        got = {(r.arm, r.site): r for r in design.marginal_means(table, fit, made, ["arm", "site"]).collect()}
        assert len(got) == 6
        z = float(np.mean([r.z for r in rows]))
        cell = lambda a, s: np.array([1, z, a == "b", a == "c", s == "y", a == "b" and s == "y", a == "c" and s == "y"], float)
        for (a, s), r in got.items():
            c = cell(a, s)
            se = math.sqrt(c @ v @ c)
            assert (r.cell_mean, r.se) == (pytest.approx(mean(c @ b)), pytest.approx(se, rel=1e-6))
            assert (r.low, r.high) == (pytest.approx(mean(c @ b - 1.959964 * se)), pytest.approx(mean(c @ b + 1.959964 * se)))
        con = design.cell_contrasts(table, fit, made, ["arm", "site"], [(("c", "y"), ("c", "x"))]).first()
        h = 1e-6
        of = lambda q: mean(cell("c", "y") @ q) - mean(cell("c", "x") @ q)
        g = np.array([(of(b + h * e) - of(b - h * e)) / (2 * h) for e in np.eye(7)])
        assert con.difference == pytest.approx(of(b)) and con.high - con.difference == pytest.approx(1.959964 * math.sqrt(g @ v @ g), rel=1e-5)
        assert (con.ratio is None) == (family == "gaussian") and (con.ratio is None or con.ratio == pytest.approx(math.exp((cell("c", "y") - cell("c", "x")) @ b)))
        part = design.marginal_means(table, fit, made, ["site"]).collect()
        assert len(part) == 2
        x_mean = x.mean(axis=0)
        assert part[0].cell_mean == pytest.approx(mean(b[:4] @ x_mean[:4]))
    with pytest.raises(ContractError):
        design.marginal_means(table, fit, made, ["z"])


def test_means_over_a_random_intercept():
    assert design.averaged(0.7, "poisson", 0.8)[0] == pytest.approx(math.exp(0.7 + 0.32), rel=1e-10)
    grid = np.linspace(-8, 8, 20001)
    w = np.exp(-grid**2 / 2) / np.exp(-grid**2 / 2).sum()
    p = 1 / (1 + np.exp(-(0.7 + 1.3 * grid)))
    mean, slope = design.averaged(0.7, "binomial", 1.3)
    assert mean == pytest.approx(w @ p, rel=1e-8) and slope == pytest.approx(w @ (p * (1 - p)), rel=1e-6)
    assert design.averaged(0.7, "gaussian", 2.0) == (pytest.approx(0.7), pytest.approx(1.0))


def test_robust_covariance_equals_the_dense_sandwich(table):
    made = design.model_matrix(table, ["z", "arm"], ["arm"])
    df, (rows, x) = made.apply(table), dense(table)
    x, g = x[:, :4], np.array([r.g for r in rows])
    for family, y in (("poisson", "n"), ("binomial", "y"), ("gaussian", "v"), ("negative_binomial", "n")):
        fit = fit_one(df, y, made.names, family)
        got = design.robust_covariance(df, fit, y, "g")
        e, obs = x @ np.array(fit["coefficients"]), np.array([getattr(r, y) for r in rows])
        mu = {"binomial": 1 / (1 + np.exp(-e)), "gaussian": e}.get(family, np.exp(e))
        shrink = 1 + mu / fit["theta"] if family == "negative_binomial" else np.ones_like(mu)
        w = {"binomial": mu * (1 - mu), "gaussian": np.ones_like(mu), "poisson": mu}.get(family, mu / shrink)
        scores = np.array([((obs - mu) / shrink)[g == k] @ x[g == k] for k in np.unique(g)])
        bread = np.linalg.inv((x * w[:, None]).T @ x)
        want = bread @ (scores.T @ scores) @ bread * len(scores) / (len(scores) - 1)
        assert np.allclose(got["covariance"], want, rtol=1e-6) and got["n_clusters"] == len(scores) and got["coefficients"] == fit["coefficients"]


def test_access_difference(spark):
    rows = [(1, True, True, 5), (1, False, True, 40), (2, True, False, None), (2, False, True, 30), (3, True, True, 2), (3, False, False, 3), (4, None, True, 1), (5, True, None, 4)]
    df = spark.createDataFrame(rows, "pair long, arm boolean, offered boolean, days int")
    r = design.access_difference(df, "days", F.col("offered"), F.col("arm"), "pair", 30).first()
    assert (r.n, r.n_clusters) == (7, 4) and r.access_first == pytest.approx(1 / 3) and r.access_second == pytest.approx(2 / 4)
    s = {1: 0.5 / 4 - (0 - 1 / 3) / 3, 2: -0.5 / 4 - (2 / 3) / 3, 3: 0.5 / 4 - (0 - 1 / 3) / 3, 5: -0.5 / 4}
    se = math.sqrt(sum(v * v for v in s.values()) * 4 / 3)
    assert r.high - r.difference == pytest.approx(1.959964 * se, rel=1e-6) and 0 < r.p_value < 1
