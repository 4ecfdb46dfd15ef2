"""Quantile residuals of count models and the tests on them: distribution functions as Columns, seeded jitter, no simulation.

A residual is the distribution function of a row's own fit, taken at a point
between the step before the count and the step at it; the point comes from a
hash of the seed and the row's key, so any system with md5 can give it again.
Under the right model residuals are uniform. Distribution functions are the
regularised incomplete gamma (Poisson) and beta (negative binomial) functions
by continued fractions and series over whole Arrow batches, to convergence.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators import batch
from plinth.operators.stats import ks_distance, ks_p, normal_tail, predict, uniform_cdf
from plinth.operators.windows import hashed

#: Terms after which a series or fraction that has not met the tolerance is an error.
MOST_TERMS, EPS, TINY = 20_000, 1e-15, 1e-300


def _refine(step, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Runs `step(k, rows)` -> factor until the factors of all rows are within EPS of 1; the product with `start`."""
    out, left = start.copy(), rows
    for k in range(1, MOST_TERMS):
        if not len(left):
            return out
        factor = step(k, left)
        out[left] *= factor
        left = left[np.abs(factor - 1) > EPS]
    raise ArithmeticError("an incomplete gamma or beta function did not converge")


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0, x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    a, x, out = a.ravel(), x.ravel(), np.ones(a.size)
    front = np.exp(np.where(x > 0, a * np.log(np.maximum(x, TINY)) - x, -np.inf) - batch.log_gamma(a))
    series = np.flatnonzero((x > 0) & (x < a + 1))
    total, term = np.zeros(a.size), np.zeros(a.size)
    total[series] = term[series] = 1 / a[series]
    left = series
    for k in range(1, MOST_TERMS):
        if not len(left):
            break
        term[left] *= x[left] / (a[left] + k)
        total[left] += term[left]
        left = left[term[left] > total[left] * EPS]
    else:
        raise ArithmeticError("an incomplete gamma function did not converge")
    out[series] = 1 - total[series] * front[series]
    rows = np.flatnonzero(x >= a + 1)
    b = x + 1 - a
    c, d = np.full(a.size, 1 / TINY), 1 / np.where(np.abs(b) < TINY, TINY, b)

    def step(k: int, at: np.ndarray) -> np.ndarray:
        an, bk = -k * (k - a[at]), b[at] + 2 * k
        d[at] = 1 / np.where(np.abs(v := an * d[at] + bk) < TINY, TINY, v)
        c[at] = np.where(np.abs(v := bk + an / c[at]) < TINY, TINY, v)
        return c[at] * d[at]

    h = _refine(step, d.copy(), rows)
    out[rows] = h[rows] * front[rows]
    return np.clip(out, 0, 1)


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0 and x in [0, 1]."""
    a, b, x = (v.ravel() for v in np.broadcast_arrays(*[np.asarray(v, float) for v in (a, b, x)]))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inner = (z > 0) & (z < 1)
    z1 = np.where(inner, z, 0.5)
    front = np.exp(batch.log_gamma(p + q) - batch.log_gamma(p) - batch.log_gamma(q) + p * np.log(z1) + q * np.log1p(-z1)) / p
    guard = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones(a.size), 1 / guard(1 - (p + q) * z1 / (p + 1))

    def step(k: int, at: np.ndarray) -> np.ndarray:
        pk, qk, zk = p[at], q[at], z1[at]
        even = k * (qk - k) * zk / ((pk + 2 * k - 1) * (pk + 2 * k))
        d[at] = 1 / guard(1 + even * d[at])
        c[at] = guard(1 + even / c[at])
        first = c[at] * d[at]
        odd = -(pk + k) * (pk + q[at] + k) * zk / ((pk + 2 * k) * (pk + 2 * k + 1))
        d[at] = 1 / guard(1 + odd * d[at])
        c[at] = guard(1 + odd / c[at])
        return first * c[at] * d[at]

    h = _refine(step, d.copy(), np.flatnonzero(inner))
    low = np.where(inner, front * h, np.where(z >= 1, 1.0, 0.0))
    return np.clip(np.where(turn, 1 - low, low), 0, 1)


@F.pandas_udf(T.DoubleType())
def _poisson_cdf(k: pd.Series, mu: pd.Series) -> pd.Series:
    k, mu = k.to_numpy(float), mu.to_numpy(float)
    known = ~(np.isnan(k) | np.isnan(mu))
    out = np.where(known, 0.0, np.nan)
    at = np.flatnonzero(known & (k >= 0))
    out[at] = gamma_upper(np.floor(k[at]) + 1, mu[at])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _negative_binomial_cdf(k: pd.Series, mu: pd.Series, theta: pd.Series) -> pd.Series:
    k, mu, theta = k.to_numpy(float), mu.to_numpy(float), theta.to_numpy(float)
    known = ~(np.isnan(k) | np.isnan(mu) | np.isnan(theta))
    out = np.where(known, 0.0, np.nan)
    at = np.flatnonzero(known & (k >= 0))
    out[at] = beta_lower(theta[at], np.floor(k[at]) + 1, theta[at] / (theta[at] + mu[at]))
    return pd.Series(out)


def poisson_cdf(k: Column, mu: Column) -> Column:
    """P(Y <= k) of a Poisson count; 0 below zero, null (NaN turned null) where an argument is null."""
    return F.nanvl(_poisson_cdf(k.cast("double"), mu.cast("double")), F.lit(None).cast("double"))


def negative_binomial_cdf(k: Column, mu: Column, theta: float | Column) -> Column:
    """P(Y <= k) of a negative binomial count with mean mu and variance mu + mu^2 / theta."""
    t = theta if isinstance(theta, Column) else F.lit(float(theta))
    return F.nanvl(_negative_binomial_cdf(k.cast("double"), mu.cast("double"), t.cast("double")), F.lit(None).cast("double"))


def count_cdf(fit: Mapping[str, object], k: Column, mu: Column) -> Column:
    if fit["family"] == "poisson":
        return poisson_cdf(k, mu)
    if fit["family"] == "negative_binomial":
        return negative_binomial_cdf(k, mu, float(fit["theta"]))
    raise ValueError(f"no counts in a {fit['family']} model")


def jitter(seed: int, keys: Sequence[str]) -> Column:
    """A number in (0, 1) for each row, from a hash of the seed and the keys."""
    return (F.conv(F.substring(hashed(seed, *keys), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)


def quantile_residuals(df: DataFrame, fit: Mapping[str, object], outcome: str, keys: Sequence[str], seed: int = 0, name: str = "residual") -> DataFrame:
    """`df` plus fitted mean `mu` and the residual in [0, 1]; null where the outcome or a covariate is."""
    y = F.col(outcome)
    rows = predict(df, fit, "mu")
    rows = rows.withColumn("_below", count_cdf(fit, y - 1, F.col("mu"))).withColumn("_at", count_cdf(fit, y, F.col("mu")))
    return rows.withColumn(name, F.col("_below") + jitter(seed, keys) * (F.col("_at") - F.col("_below"))).drop("_below", "_at")


def residual_tests(df: DataFrame, fit: Mapping[str, object], outcome: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """test, statistic, p_value and n of a count model.

    uniformity: Kolmogorov-Smirnov distance of the residuals. dispersion: Pearson chi-squared over its degrees of
    freedom, its p from the variance of the rows' Pearson terms under the model. zeros: observed over expected zeros,
    p from the independent chances of a zero.
    """
    rows = quantile_residuals(df.dropna(subset=[outcome, *fit["names"][1:]]), fit, outcome, keys, seed)
    d, n = ks_distance(rows.select("residual"), "residual", uniform_cdf).first()
    mu, theta = F.col("mu"), float(fit["theta"] or math.inf)
    spread = mu if math.isinf(theta) else mu + mu * mu / theta
    # Excess kurtosis of the family gives the variance of a squared Pearson residual: 2 + excess.
    excess = 1 / mu if math.isinf(theta) else 6 / theta + 1 / spread
    none = F.exp(-mu) if math.isinf(theta) else F.pow(theta / (theta + mu), F.lit(theta))
    y = F.col(outcome)
    got = rows.agg(F.sum((y - mu) ** 2 / spread), F.sum(2 + excess), F.sum((y == 0).cast("int")), F.sum(none), F.sum(none * (1 - none))).first()
    free = max(n - len(fit["names"]), 1)
    z = (got[0] - free) / math.sqrt(got[1]) if got[1] else 0.0
    z0 = (got[2] - got[3]) / math.sqrt(got[4]) if got[4] else 0.0
    out = [("uniformity", float(d), ks_p(d, n), n), ("dispersion", float(got[0] / free), normal_tail(z), n), ("zeros", float(got[2] / got[3]) if got[3] else None, normal_tail(z0), n)]
    return df.sparkSession.createDataFrame(out, "test string, statistic double, p_value double, n long")
