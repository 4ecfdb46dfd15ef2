"""Models with two random intercepts, nested or crossed: binomial, Poisson and negative binomial by Laplace's approximation.

Groups of the two factors that share rows form components (two factors of a
matched study: the pair and the clinicians in it). A component's likelihood
does not hang on the others, so its rows are gathered once, as arrays in one
row of a written table; then every round is one pass over components that
finds the modes of their intercepts by Newton's method for a few parameter
vectors at once, adds the logarithm of the determinant of their information,
and takes one number for each vector back. Fits move by Newton steps from finite
differences of these numbers. Equal rows of two groups are one row with a count.

Groups of one factor share no rows, so both diagonal blocks of the information
are diagonal and the larger one is eliminated. A component with a single group
of one factor (nested groups) leaves one number, and all such components of a
batch are solved by sums over their rows. The others leave a dense block of the
smaller factor, those of alike size together. So groups and rows of a component
are bounded; beyond `most_groups` or `most_rows` is an error that names the
bound, not a sample.
Rows with a null in the outcome, a covariate or a factor are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.batch import fit_one, log_gamma
from plinth.operators.graph import components
from plinth.operators.lineage import cut
from plinth.sources.io import ContractError


def slopes(y: np.ndarray, eta: np.ndarray, family: str, theta: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and observed curvature (positive) of the log likelihood in the linear predictor."""
    if family == "binomial":
        mu = 1 / (1 + np.exp(-eta))
        return y - mu, mu * (1 - mu)
    mu = np.exp(np.minimum(eta, 50))
    if family == "poisson":
        return y - mu, mu
    share = mu / (theta + mu)
    return y - (y + theta) * share, (y + theta) * share * (1 - share)


def constants(y: np.ndarray, family: str, theta: float) -> np.ndarray:
    """The part of the log likelihood that does not hang on the predictor."""
    if family == "binomial":
        return np.zeros_like(y)
    return -log_gamma(y + 1) if family == "poisson" else log_gamma(y + theta) - log_gamma(np.array(theta)) - log_gamma(y + 1)


def log_terms(y: np.ndarray, eta: np.ndarray, family: str, theta: float) -> np.ndarray:
    """The part of the log likelihood that hangs on the predictor."""
    if family == "binomial":
        return y * eta - np.logaddexp(0, eta)
    mu = np.exp(np.minimum(eta, 50))
    return y * eta - mu if family == "poisson" else -theta * np.log1p(mu / theta) + y * np.log(mu / (theta + mu) + 1e-300)


def row_terms(y: np.ndarray, eta: np.ndarray, family: str, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, its slope and its observed curvature (positive) in the linear predictor."""
    return (log_terms(y, eta, family, theta) + constants(y, family, theta), *slopes(y, eta, family, theta))


#: Newton's steps end below this: the error left is of the order of its square.
SMALL = 1e-6


def nested_laplace(y: np.ndarray, w: np.ndarray, offset: np.ndarray, outer: np.ndarray, inner: np.ndarray, firsts: np.ndarray, owner: np.ndarray, sds: tuple[float, float], family: str, theta: float, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
    """Sum over components with one outer group each of their approximate marginal log likelihoods (without `constants`), and the modes.

    Rows: y, count, fixed part of the predictor, outer and inner group. Inner groups: their owner, which rises; `firsts` is each owner's first.
    """
    k, m = len(firsts), len(owner)
    p, q = 1 / sds[0] ** 2, 1 / sds[1] ** 2
    u, v = start if start is not None else (np.zeros(k), np.zeros(m))

    def blocks(bend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.bincount(inner, w * bend, m)
        return c, c + q, p + np.bincount(owner, c * q / (c + q), k)

    for _ in range(60):
        slope, bend = slopes(y, offset + u[outer] + v[inner], family, theta)
        c, d, s = blocks(bend)
        g = np.bincount(inner, w * slope, m)
        top, g = np.bincount(owner, g, k) - p * u, g - q * v
        du = (top - np.bincount(owner, c / d * g, k)) / s
        dv = (g - c * du[owner]) / d
        scale = np.minimum(1, 3 / np.maximum(np.maximum(np.abs(du), np.maximum.reduceat(np.abs(dv), firsts)), 1e-12))
        du, dv = du * scale, dv * scale[owner]
        u, v = u + du, v + dv
        if max(np.abs(du).max(), np.abs(dv).max()) < SMALL:
            break
    eta = offset + u[outer] + v[inner]
    _, d, s = blocks(slopes(y, eta, family, theta)[1])
    spread = np.log(d).sum() + np.log(s).sum() + 2 * (k * math.log(sds[0]) + m * math.log(sds[1])) + p * (u**2).sum() + q * (v**2).sum()
    return float(w @ log_terms(y, eta, family, theta)) - 0.5 * float(spread), (u, v)


def laplace(y: np.ndarray, w: np.ndarray, offset: np.ndarray, few: np.ndarray, many: np.ndarray, groups: tuple[np.ndarray, np.ndarray], sds: tuple[float, float], family: str, theta: float, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
    """The same of any components, padded (components x rows): the block of the second factor is eliminated, that of the first solved densely.

    Padded rows have the count 0; padded groups get precision 1 and no rows. `groups` are the numbers of groups.
    """
    n = len(y)
    k1, k2 = int(groups[0].max()), int(groups[1].max())
    held = [np.arange(k)[None, :] < g[:, None] for k, g in zip((k1, k2), groups)]
    p, q = (np.where(h, 1 / sd**2, 1.0) for h, sd in zip(held, sds))
    at = np.arange(n)[:, None]
    by_few, by_many, by_both = (at * k1 + few).ravel(), (at * k2 + many).ravel(), ((at * k1 + few) * k2 + many).ravel()
    u, v = start if start is not None else (np.zeros((n, k1)), np.zeros((n, k2)))

    def predictor() -> np.ndarray:
        return offset + np.take_along_axis(u, few, 1) + np.take_along_axis(v, many, 1)

    def blocks(bend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.bincount(by_both, (bend * w).ravel(), n * k1 * k2).reshape(n, k1, k2)
        d = c.sum(axis=1) + q
        s = -(c / d[:, None, :]) @ c.transpose(0, 2, 1)
        s[:, np.arange(k1), np.arange(k1)] += c.sum(axis=2) + p
        return c, d, s

    for _ in range(60):
        slope, bend = slopes(y, predictor(), family, theta)
        c, d, s = blocks(bend)
        g = np.bincount(by_few, (slope * w).ravel(), n * k1).reshape(n, k1) - p * u
        h = np.bincount(by_many, (slope * w).ravel(), n * k2).reshape(n, k2) - q * v
        du = np.linalg.solve(s, g[:, :, None] - c @ (h / d)[:, :, None])[:, :, 0]
        dv = (h - (du[:, None, :] @ c)[:, 0, :]) / d
        scale = np.minimum(1, 3 / np.maximum(np.maximum(np.abs(du).max(axis=1, keepdims=True), np.abs(dv).max(axis=1, keepdims=True)), 1e-12))
        du, dv = du * scale, dv * scale
        u, v = u + du, v + dv
        if max(np.abs(du).max(), np.abs(dv).max()) < SMALL:
            break
    eta = predictor()
    _, d, s = blocks(slopes(y, eta, family, theta)[1])
    spread = np.log(d).sum() + np.linalg.slogdet(s)[1].sum() + 2 * sum(h.sum() * math.log(sd) for h, sd in zip(held, sds)) + (p * u**2).sum() + (q * v**2).sum()
    return float((w * log_terms(y, eta, family, theta)).sum()) - 0.5 * float(spread), (u, v)


def gathered(df: DataFrame, outcome: str, covariates: Sequence[str], first: str, second: str, most_groups: int, most_rows: int) -> DataFrame:
    """One row for each component: y, w (count), x (rows x columns, flat), a and b (codes from 0), n_a, n_b."""
    q = lambda c: F.col(f"`{c}`")
    x = F.array(F.lit(1.0), *[q(c).cast("double") for c in covariates])
    rows = df.dropna(subset=[outcome, *covariates, first, second])
    rows = cut(rows.select(q(outcome).cast("double").alias("y"), x.alias("x"), F.concat(F.lit("a"), q(first).cast("string")).alias("a"), F.concat(F.lit("b"), q(second).cast("string")).alias("b")))
    # Where each group of one factor lies in a single group of the other, the latter are the components.
    alone = lambda group, of: rows.groupBy(group).agg(F.min(of).alias("l"), F.max(of).alias("h")).where("l <> h").isEmpty()
    owner = "a" if alone("b", "a") else "b" if alone("a", "b") else None
    if owner:
        placed = rows.withColumn("component", F.col(owner))
    else:
        of = components(rows.select(F.col("a").alias("u"), F.col("b").alias("v")))
        placed = rows.join(of.select(F.col("node").alias("a"), "component"), "a")
    most = placed.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most is None:
        raise ContractError("no complete rows to fit")
    if most > most_rows:
        raise ContractError(f"a component has {most} rows; at most {most_rows} rows and {most_groups} groups are solved densely")
    counted = placed.repartition("component").groupBy("component", "a", "b", "x", "y").agg(F.count("*").cast("double").alias("w"))
    lists = counted.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("a", "b", "x", "y", "w"))).alias("r"))
    codes = lists.withColumn("as_", F.array_distinct("r.a")).withColumn("bs", F.array_sort(F.array_distinct("r.b")))
    held = cut(codes.select(
        F.col("r.y").alias("y"), F.col("r.w").alias("w"), F.flatten("r.x").alias("x"), F.size("as_").alias("n_a"), F.size("bs").alias("n_b"),
        F.transform("r.a", lambda v: (F.array_position("as_", v) - 1).cast("int")).alias("a"), F.transform("r.b", lambda v: (F.array_position("bs", v) - 1).cast("int")).alias("b"),
    ))
    groups = held.agg(F.max(F.col("n_a") + F.col("n_b"))).first()[0]
    if groups > most_groups:
        raise ContractError(f"a component has {groups} groups; at most {most_groups} are solved densely")
    return held


def log_likelihoods(held: DataFrame, vectors: np.ndarray, p: int, family: str) -> np.ndarray:
    """Laplace log likelihood of each parameter vector (coefficients, two log sds, log theta): one pass over components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vectors))
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = {c: batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("y", "w", "x", "a", "b")}
            rows = np.diff(batch["y"].offsets.to_numpy())
            parts = {"x": flat["x"].reshape(-1, p), **{c: flat[c] for c in ("y", "w", "a", "b")}}
            n_a, n_b = (batch[c].to_numpy() for c in ("n_a", "n_b"))
            inner = np.where(n_a == 1, 1, np.where(n_b == 1, 0, -1))  # the factor with many groups, where the other has one
            for kind in (0, 1):
                if (inner == kind).any():
                    total += _nested(parts, rows, inner == kind, (n_a, n_b)[kind], kind, vectors, p, family)
            classes: dict[tuple[int, int, int], list[int]] = {}
            for i in np.flatnonzero(inner < 0):
                classes.setdefault(tuple(1 << (int(v) - 1).bit_length() for v in (rows[i], n_a[i], n_b[i])), []).append(i)
            ends = np.cumsum(rows)
            for (width, k1, k2), members in classes.items():
                most = max(1, (1 << 22) // (width * 4 + k1 * k2 + min(k1, k2) ** 2))
                for i in range(0, len(members), most):
                    some = np.array(members[i : i + most])
                    total += _padded(parts, ends[some] - rows[some], rows[some], n_a[some], n_b[some], vectors, p, family)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = held.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(len(vectors))
    for r in sums.collect():  # a number for each vector
        out[r["at"]] = r["v"]
    return out


def _each(vectors: np.ndarray, p: int, family: str, y: np.ndarray, w: np.ndarray, solve: Callable) -> np.ndarray:
    """A value for each vector by `solve(vector, sds, theta, start)`; the first one's modes are near those of the others, which differ from it by little."""
    values, ways = np.unique(y, return_inverse=True)
    counts = np.bincount(ways.ravel(), w.ravel(), len(values))
    out, start = np.zeros(len(vectors)), None
    for i, vector in enumerate(vectors):
        theta = math.exp(vector[p + 2]) if family == "negative_binomial" else 1.0
        value, modes = solve(vector[:p], np.exp(vector[p : p + 2]), theta, start)
        start = modes if start is None else start
        out[i] = value + float(counts @ constants(values, family, theta))
    return out


def _nested(parts: Mapping[str, np.ndarray], rows: np.ndarray, own: np.ndarray, groups: np.ndarray, kind: int, vectors: np.ndarray, p: int, family: str) -> np.ndarray:
    """Components `own`, whose factor `kind` (0: a, 1: b) has `groups` groups and whose other one has one."""
    keep = np.repeat(own, rows)
    y, w, x = (parts[c][keep] for c in ("y", "w", "x"))
    outer, firsts = np.repeat(np.arange(own.sum()), rows[own]), np.cumsum(groups[own]) - groups[own]
    inner, owner = firsts[outer] + parts["ab"[kind]][keep], np.repeat(np.arange(own.sum()), groups[own])
    order = (1 - kind, kind)  # sds of the outer and the inner factor
    return _each(vectors, p, family, y, w, lambda beta, sds, theta, start: nested_laplace(y, w, x @ beta, outer, inner, firsts, owner, (sds[order[0]], sds[order[1]]), family, theta, start))


def _padded(parts: Mapping[str, np.ndarray], begins: np.ndarray, rows: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, vectors: np.ndarray, p: int, family: str) -> np.ndarray:
    at = np.arange(rows.max())[None, :]
    real = at < rows[:, None]
    place = np.where(real, begins[:, None] + at, begins[:, None])
    y, w, x, a, b = (parts[c][place] for c in ("y", "w", "x", "a", "b"))
    w = w * real
    few, many, groups, order = (a, b, (n_a, n_b), (0, 1)) if n_a.max() <= n_b.max() else (b, a, (n_b, n_a), (1, 0))
    return _each(vectors, p, family, y, w, lambda beta, sds, theta, start: laplace(y, w, x @ beta, few, many, groups, (sds[order[0]], sds[order[1]]), family, theta, start))


def maximise(evaluate: Callable[[np.ndarray], np.ndarray], v: np.ndarray, least: np.ndarray, rounds: int = 30, h: float = 1e-3, tolerance: float = 1e-5) -> tuple[np.ndarray, float, np.ndarray, bool]:
    """(vector, value, Hessian, converged) of the maximum, by Newton steps on finite differences; entries stay at `least` or above.

    `evaluate` takes several vectors at once: a round asks twice, for the differences and for step sizes.
    """
    q, unit, base, hessian = len(v), np.eye(len(v)) * h, -math.inf, -np.eye(len(v))
    for _ in range(rounds):
        points = [v, *(v + unit), *(v - unit), *[v + unit[i] + unit[j] for i in range(q) for j in range(i)]]
        f = evaluate(np.array(points))
        base, up, down = float(f[0]), f[1 : q + 1], f[q + 1 : 2 * q + 1]
        gradient, hessian, at = (up - down) / (2 * h), np.diag((up - 2 * base + down) / h**2), 2 * q + 1
        for i in range(q):
            for j in range(i):
                hessian[i, j] = hessian[j, i] = (f[at] - up[i] - up[j] + base) / h**2
                at += 1
        free = ~((v <= least + 1e-9) & (gradient < 0))  # an entry at its bound that wants lower stays there
        values, axes = np.linalg.eigh(hessian[np.ix_(free, free)])
        step = np.zeros(q)
        step[free] = axes @ ((axes.T @ gradient[free]) / np.maximum(np.abs(values), 1e-6))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if not free.any() or np.abs(step).max() < tolerance or gradient @ step < tolerance:
            return v, base, hessian, True
        tried = [np.maximum(v + s * step, least) for s in (1.0, 0.5, 0.2, 0.05)]
        values_there = evaluate(np.array(tried))
        if values_there.max() <= base:
            return v, base, hessian, bool(gradient @ step < 1e-2)
        v = tried[int(values_there.argmax())]
    return v, base, hessian, False


def fit_crossed(df: DataFrame, outcome: str, covariates: Sequence[str], first: str, second: str, family: str = "binomial", most_groups: int = 1_000, most_rows: int = 20_000, rounds: int = 30) -> dict[str, object]:
    """A fit with intercepts of `first` and `second`; `sds` are their standard deviations, `covariance` that of the coefficients.

    A standard deviation at its lower bound (e**-6) is one that the data do not show; `positive_definite` is then of the other parameters.
    """
    if family not in ("binomial", "poisson", "negative_binomial"):
        raise ValueError(f"no mixed model of {family}")
    held = gathered(df, outcome, covariates, first, second, most_groups, most_rows)
    start = fit_one(df.dropna(subset=[first, second]), outcome, covariates, "binomial" if family == "binomial" else "poisson")
    p = len(covariates) + 1
    more = [math.log(0.4), math.log(0.3), *([math.log(2.0)] if family == "negative_binomial" else [])]
    v = np.array([*start["coefficients"], *more])
    least = np.array([*[-math.inf] * p, -6.0, -6.0, *([-8.0] if len(more) > 2 else [])])
    v, best, hessian, converged = maximise(lambda vectors: log_likelihoods(held, vectors, p, family), v, least, rounds)
    free = ~(v <= least + 1e-9)
    spread = np.linalg.eigvalsh(-hessian[np.ix_(free, free)])
    covariance = np.linalg.pinv(-hessian[np.ix_(free, free)])[:p, :p]
    return {
        "family": family, "names": ["(intercept)", *covariates], "coefficients": v[:p].tolist(), "errors": np.sqrt(np.maximum(np.diag(covariance), 0)).tolist(), "covariance": covariance.tolist(),
        "factors": [first, second], "sds": np.exp(v[p : p + 2]).tolist(), "at_bound": (~free[p : p + 2]).tolist(), "theta": float(math.exp(v[p + 2])) if len(more) > 2 else None,
        "log_likelihood": best, "n": start["n"], "converged": converged, "positive_definite": bool(spread.min() > 0),
    }


def intercept_components(df: DataFrame, fit: Mapping[str, object], outcome: str) -> DataFrame:
    """factor, variance, sd, icc of each intercept and of the residual on the latent scale.

    The residual variance is pi^2 / 3 on the logit scale and log(1 + 1/m + 1/theta) for counts of mean m (the mean of
    the rows fitted). A variance at its bound counts as 0.
    """
    rows = df.dropna(subset=[outcome, *fit["names"][1:], *fit["factors"]])
    if fit["family"] == "binomial":
        residual = math.pi**2 / 3
    else:
        mean = float(rows.agg(F.avg(outcome)).first()[0])
        residual = math.log1p(1 / mean + (1 / fit["theta"] if fit["theta"] else 0.0))
    variances = [0.0 if low else sd**2 for sd, low in zip(fit["sds"], fit["at_bound"])]
    total = sum(variances) + residual
    out = [(f, v, math.sqrt(v), v / total) for f, v in [*zip(fit["factors"], variances), ("residual", residual)]]
    return df.sparkSession.createDataFrame(out, "factor string, variance double, sd double, icc double")
