import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import batch, stats
from plinth.operators.batch import Request
from plinth.sources.io import ContractError


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b, c = float(rng.normal()), float(rng.integers(0, 2)), float(rng.normal())
        count = float(rng.poisson(rng.gamma(2.0, math.exp(0.8 + 0.4 * b - 0.2 * a) / 2.0)))
        rows.append((i // 3, a, b if i % 50 else None, c, float(rng.random() < 1 / (1 + math.exp(-0.3 - 0.8 * a))), count, i))
    return spark.createDataFrame(rows, "g long, a double, b double, c double, y double, n double, i long").checkpoint()


def test_fits_equal_the_serial_ones(table):
    keep = [F.col("i") % 3 == 0, F.lit(True), F.col("g") > 100, F.lit(None).cast("boolean") | (F.col("i") < 500)]
    sets = [("a", "b", "c"), ("a",), ("b", "c"), ()]
    for family, y in (("binomial", "y"), ("poisson", "n"), ("gaussian", "n"), ("negative_binomial", "n")):
        together = batch.fit_many(table, y, [Request(k.cast("int"), s) for k, s in zip(keep, sets)], family, theta=2.0 if family == "negative_binomial" else None)
        for fit, k, s in zip(together, keep, sets):
            alone = stats.fit_glm(table.where(k), y, list(s), family, theta=2.0)
            assert fit["converged"] and fit["n"] == alone["n"] and fit["names"] == alone["names"] and fit["scans"] <= 12
            assert fit["coefficients"] == pytest.approx(alone["coefficients"], abs=1e-7) and fit["errors"] == pytest.approx(alone["errors"], rel=1e-6)


def test_theta_is_found_with_the_coefficients(table):
    fit, half = batch.fit_many(table, "n", [Request(None, ("a", "b")), Request((F.col("i") % 2).cast("int"), ("a",))], "negative_binomial")
    alone = stats.fit_negative_binomial(table, "n", ["a", "b"])
    assert fit["theta"] == pytest.approx(alone["theta"], rel=1e-5) and fit["coefficients"] == pytest.approx(alone["coefficients"], abs=1e-6)
    assert fit["log_likelihood"] == pytest.approx(alone["log_likelihood"], abs=1e-6)
    assert half["theta"] == pytest.approx(stats.fit_negative_binomial(table.where("i % 2 = 1"), "n", ["a"])["theta"], rel=1e-5)


def test_draws_share_scans(table, monkeypatch):
    scans = []
    plain = batch.scan
    monkeypatch.setattr(batch, "scan", lambda *a, **k: scans.append(1) or plain(*a, **k))
    one = batch.fit_one(table, "y", ["a", "b", "c"])
    alone, got = len(scans), {r.term: r for r in stats.retention(table, "y", ["a", "b", "c"], ["g"], draws=12, below=0.05).collect()}
    assert one["scans"] == alone and len(scans) - alone <= alone + 2
    kept = dict.fromkeys("abc", 0)
    for draw in range(12):
        w = table.withColumn("w", stats.poisson_weight("g", draw=draw)).where("w > 0")
        fit = stats.fit_glm(w, "y", ["a", "b", "c"], weight="w")
        for name, b, e in list(zip(fit["names"], fit["coefficients"], fit["errors"]))[1:]:
            kept[name] += stats.normal_tail(b / e) < 0.05
    assert {t: r.n_kept for t, r in got.items()} == kept and got["a"].share == 1.0 and got["a"].n_draws == 12


def test_count_validation(table):
    folds = stats.cross_validated(table, "n", ["a", "b"], "g", 3, 1, family="negative_binomial").orderBy("fold").collect()
    for r in folds:
        marked = table.dropna(subset=["b"]).withColumn("f", stats.folds("g", 3, 1))
        fit = stats.fit_negative_binomial(marked.where(F.col("f") != r.fold), "n", ["a", "b"])
        test = stats.predict(marked.where(F.col("f") == r.fold), fit, "p")
        rmse, mae = test.agg(F.sqrt(F.avg((F.col("n") - F.col("p")) ** 2)), F.avg(F.abs(F.col("n") - F.col("p")))).first()
        assert (r.rmse, r.mae, r.n) == (pytest.approx(rmse, rel=1e-6), pytest.approx(mae, rel=1e-6), test.count())
        assert r.mean_log_likelihood == pytest.approx(stats.log_likelihood(test.drop("p"), fit, "n") / r.n, rel=1e-6)
    late = stats.temporal_validation(table, "n", ["a", "b"], F.col("i") >= 600).first()
    assert late.n_train + late.n_test == 882 and late.rmse > 0 and abs(late.slope - 1) < 1 and abs(late.bias) < 1
    with pytest.raises(ContractError):
        stats.temporal_validation(table, "n", ["a"], F.col("i") > 10_000)


def test_no_rows_and_no_family(table):
    with pytest.raises(ContractError):
        batch.fit_one(table.where("false"), "y", ["a"])
    with pytest.raises(ValueError):
        batch.fit_one(table, "y", ["a"], "gamma")
    some, none = batch.fit_many(table, "y", [Request(None, ("a",)), Request((F.col("i") < 0).cast("int"), ("a",))])
    assert some["converged"] and none["n"] == 0 and none["coefficients"] == [None, None] and not none["converged"]


def test_draws_are_hashed_once_a_cluster(spark):
    from pyspark.sql import functions as F

    from plinth.operators import stats

    rows = [(i, None if i % 11 == 0 else i % 7, "u" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a int, b string")
    got = stats.with_draws(df, ["a", "b"], 6)
    assert got.columns == ["i", "a", "b", "_draws"]
    assert {r.i: r._draws for r in got.collect()} == {r.i: r.d for r in df.select("i", stats.drawn(["a", "b"], 6).alias("d")).collect()}
    assert "_draws" in got._jdf.queryExecution().optimizedPlan().toString() and "Join" in got._jdf.queryExecution().optimizedPlan().toString()


def test_nested_counts_test_equals_the_test_of_single_rows(spark):
    from plinth.operators import stats
    from plinth.operators.batch import fit_one

    rows = [(i * 7 % 13, i % 3, None if i % 17 == 0 else i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, a int, b int").repartition(3)
    whole = df.dropna()
    large, small = (fit_one(whole, "y", names, "poisson") for names in (["a", "b"], ["a"]))
    want, got = (t.first() for t in (stats.nested_test(df, small, large, "y"), stats.nested_counts_test(df, "y", ["a", "b"], ["a"])))
    assert abs(want.chi2 - got.chi2) < 1e-8 and want.df == got.df == 1 and abs(want.p_value - got.p_value) < 1e-8
