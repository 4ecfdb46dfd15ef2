"""Many weighted generalised linear models in one scan a round.

Fits of one outcome differ in their row weights (bootstrap draws, folds,
filters) and in which columns of the design they use. The outcome, the design
and the weights are written once; every round is one pass in Arrow tasks that
adds up, for each fit, the information, the score and the log likelihood at its
own coefficients. Each task sends one array, so a round moves
fits * (p (p + 1) / 2 + p + 6) numbers for each task and no row, and B fits
take as many scans as the slowest of them has rounds.

Families: gaussian (identity), binomial (logit), poisson and negative_binomial
(log; theta by maximum likelihood together with the coefficients, or given).
A row with a null outcome is left out of all fits, one with a null covariate of
the fits that use it; a null weight is 0. A fit without rows has null coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.lineage import cut
from plinth.sources.io import ContractError

FAMILIES = ("gaussian", "binomial", "poisson", "negative_binomial")
#: Sums of a fit besides information and score: log likelihood, rows, weight, theta's slope and curve, moments for its start.
EXTRA = 7


@dataclass
class Request:
    """One fit: the weight of a row (null: 0) and the covariates it uses."""

    weight: Column | None = None
    covariates: Sequence[str] = field(default_factory=tuple)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight, for x > 0."""
    z, shift = x + 8, np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - shift


def digamma(x: np.ndarray) -> np.ndarray:
    z, shift = x + 8, 1 / x
    for k in range(1, 8):
        shift = shift + 1 / (x + k)
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - shift


def trigamma(x: np.ndarray) -> np.ndarray:
    z, shift = x + 8, 1 / x**2
    for k in range(1, 8):
        shift = shift + 1 / (x + k) ** 2
    return 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) + shift


def row_terms(y: np.ndarray, eta: np.ndarray, family: str, theta: np.ndarray | None, start: bool) -> tuple[np.ndarray, ...]:
    """(weight of the information, weighted working residual, log likelihood, mean) of rows (n x 1) and fits (n x B).

    At the `start` of log-link fits the mean is the count itself, moved off zero, and the residual is taken from there
    to the working response, so that no scan is spent on a starting value.
    """
    if family == "gaussian":
        return np.ones_like(eta), y - eta, -((y - eta) ** 2), eta
    if family == "binomial":
        mu = 1 / (1 + np.exp(-eta))
        return np.maximum(mu * (1 - mu), 1e-10), y - mu, y * eta - np.logaddexp(0, eta), mu
    if start:
        mu = np.broadcast_to(y + 0.1, eta.shape)
        return mu, mu * (np.log(mu) + (y - mu) / mu), np.zeros_like(eta), mu
    mu = np.exp(np.minimum(eta, 50))
    if family == "poisson" or theta is None:
        return mu, y - mu, y * eta - mu - log_gamma(y + 1), mu
    shrink = 1 + mu / theta
    log_l = log_gamma(y + theta) - log_gamma(theta) - log_gamma(y + 1) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu) + 1e-300)
    return mu / shrink, (y - mu) / shrink, log_l, mu


def batch_sums(y: np.ndarray, x: np.ndarray, w: np.ndarray, beta: np.ndarray, family: str, theta: np.ndarray | None, start: bool, want_theta: bool) -> np.ndarray:
    """All sums of a batch of rows, fits x numbers."""
    p, pairs = x.shape[1], np.triu_indices(x.shape[1])
    y = y[:, None]
    info, residual, log_l, mu = row_terms(y, x @ beta.T, family, theta, start)
    out = [(w * info).T @ (x[:, pairs[0]] * x[:, pairs[1]]), (w * residual).T @ x]
    extra = [w * log_l, (w > 0).astype(float), w]
    if want_theta:
        if theta is None:
            slope = bend = np.zeros_like(mu)
        else:
            slope = digamma(y + theta) - digamma(theta) + np.log(theta / (theta + mu)) + 1 - (y + theta) / (theta + mu)
            bend = trigamma(y + theta) - trigamma(theta) + 1 / theta - 2 / (theta + mu) + (y + theta) / (theta + mu) ** 2
        extra += [w * slope, w * bend, w * mu**2, w * ((y - mu) ** 2 - mu)]
    else:
        extra += [np.zeros_like(w)] * 4
    assert out[0].shape[1] == p * (p + 1) // 2
    return np.hstack([*out, np.stack([e.sum(axis=0) for e in extra], axis=1)])


def scan(rows: DataFrame, beta: np.ndarray, family: str, theta: np.ndarray | None = None, start: bool = False, want_theta: bool = False) -> np.ndarray:
    """One pass: the sums of every fit at its coefficients, fits x numbers."""
    fits, p = beta.shape
    width = p * (p + 1) // 2 + p + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fits, width))
        for batch in batches:
            if batch.num_rows:
                y = batch["y"].to_numpy()
                x, w = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1) for c in ("x", "w"))
                total += batch_sums(y, x, w, beta, family, theta, start, want_theta)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("at", "v"))
    got = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()  # a number for each fit and sum
    out = np.zeros(fits * width)
    for r in got:
        out[r["at"]] = r["v"]
    return out.reshape(fits, width)


def prepared(df: DataFrame, outcome: str, covariates: Sequence[str], requests: Sequence[Request], draws: Column | None = None) -> DataFrame:
    """y, x (with intercept) and w of rows that count for any fit, written once; a fit's weight is 0 where a column of its own is null.

    `draws` is an array column of all weights, for fits that all use all covariates.
    """
    q = lambda c: F.col(f"`{c}`").cast("double")
    weights = []
    for r in requests:
        weight, known = (r.weight if r.weight is not None else F.lit(1).cast("tinyint")), F.lit(True)
        for c in r.covariates:
            known &= q(c).isNotNull()
        weights.append(F.coalesce(F.when(known, weight), F.lit(0).cast("tinyint")))
    x = F.array(F.lit(1.0), *[F.coalesce(q(c), F.lit(0.0)) for c in covariates])
    if draws is not None:
        df, weights = df.dropna(subset=list(covariates)), []
    rows = df.select(q(outcome).alias("y"), x.alias("x"), (F.array(*weights) if draws is None else draws).alias("w"))
    return cut(rows.where(F.col("y").isNotNull() & F.exists("w", lambda c: c > 0)))


def fit_many(df: DataFrame, outcome: str, requests: Sequence[Request], family: str = "binomial", theta: float | None = None, rounds: int = 50, tolerance: float = 1e-9, most_theta: float = 1e6, draws: Column | None = None) -> list[dict[str, object]]:
    """One fit for each request, each as `fit_glm` returns it, plus covariance, log_likelihood and scans.

    `draws`, an array column with a weight for each request, stands for the requests' own weights.
    """
    if family not in FAMILIES:
        raise ValueError(f"no family {family}")
    names = list(dict.fromkeys(c for r in requests for c in r.covariates))
    rows = prepared(df, outcome, names, requests, draws)
    p, b = len(names) + 1, len(requests)
    use = [[0, *[names.index(c) + 1 for c in r.covariates]] for r in requests]
    beta, converged = np.zeros((b, p)), np.zeros(b, bool)
    search = family == "negative_binomial" and theta is None
    thetas = None if search or theta is None else np.full(b, float(theta))
    pairs, got, scans = np.triu_indices(p), None, 0
    infos = np.zeros((b, p, p))
    log_link = family in ("poisson", "negative_binomial")
    for scans in range(1, rounds + 1):
        start = log_link and scans == 1
        got = scan(rows, beta, family, thetas, start, search)
        infos[:, pairs[0], pairs[1]] = infos[:, pairs[1], pairs[0]] = got[:, : len(pairs[0])]
        score, extra = got[:, len(pairs[0]) : len(pairs[0]) + p], got[:, -EXTRA:]
        steps = np.zeros((b, p))
        for k in range(b):
            if extra[k, 1]:
                steps[k, use[k]] = np.linalg.lstsq(infos[k][np.ix_(use[k], use[k])], score[k, use[k]], rcond=1e-13)[0]
        small = np.abs(steps).max(axis=1) < tolerance * (1 + np.abs(beta).max(axis=1))
        if search and thetas is not None:
            slope, curve = thetas * extra[:, 3], thetas**2 * extra[:, 4] + thetas * extra[:, 3]
            move = np.clip(np.where(curve < 0, -slope / np.where(curve < 0, curve, 1.0), np.copysign(0.5, slope)), -1, 1)
            after = np.clip(np.log(thetas) + move, math.log(1e-6), math.log(most_theta))
            small &= np.abs(after - np.log(thetas)) < 1e-7
        converged = small & (extra[:, 1] > 0) & (not start) & (not search or thetas is not None)
        if (converged | (extra[:, 1] == 0)).all():
            break
        beta = beta + steps
        if search and thetas is not None:
            thetas = np.exp(after)
        elif search and scans == 3:  # two Poisson steps behind it
            over = extra[:, 6]
            thetas = np.where(over > 0, np.clip(extra[:, 5] / np.where(over > 0, over, 1.0), 1e-3, most_theta), most_theta)
    if not got[:, -EXTRA + 1].any():
        raise ContractError("no complete rows to fit")
    return [_result(requests[k], use[k], beta[k], infos[k], got[k, -EXTRA:], family, None if thetas is None else float(thetas[k]), bool(converged[k]), scans) for k in range(b)]


def _result(request: Request, use: list[int], beta: np.ndarray, info: np.ndarray, extra: np.ndarray, family: str, theta: float | None, converged: bool, scans: int) -> dict[str, object]:
    n, weight, log_l = int(extra[1]), float(extra[2]), float(extra[0])
    own = info[np.ix_(use, use)]
    scale = -log_l / max(n - len(use), 1) if family == "gaussian" else 1.0
    if family == "gaussian" and log_l < 0:
        log_l = -0.5 * n * (math.log(2 * math.pi * -log_l / n) + 1)
    covariance = np.linalg.pinv(own) * scale if n else np.full_like(own, np.nan)
    return {
        "family": family, "names": ["(intercept)", *request.covariates], "coefficients": beta[use].tolist() if n else [None] * len(use), "errors": np.sqrt(np.maximum(np.diag(covariance), 0)).tolist(),
        "covariance": covariance.tolist(), "scale": scale, "n": n, "weight": weight, "converged": converged, "positive_definite": bool(n and np.linalg.eigvalsh(own).min() > 0),
        "theta": theta, "log_likelihood": log_l, "scans": scans,
    }


def fit_one(df: DataFrame, outcome: str, covariates: Sequence[str], family: str = "binomial", **more) -> dict[str, object]:
    """A single fit with its covariance."""
    return fit_many(df, outcome, [Request(covariates=covariates)], family, **more)[0]
