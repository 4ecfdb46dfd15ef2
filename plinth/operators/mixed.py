"""Mixed models with a random intercept: binomial (logit) and negative binomial (log).

The marginal likelihood of a group is a Gauss-Hermite sum over the intercept.
Equal rows of a group become one row with a count, and these are written once,
dealt by group. Each round sends a few parameter vectors to them, finishes the
groups that are whole in a task there and takes one number for each vector
back, so no round shuffles rows or groups. Only groups of more than `PIECE`
distinct rows are dealt in pieces, so that none is one task's burden; their
sums by node, one row for each piece and task, are added by a shuffle. Newton
steps use finite differences of these numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.lineage import cut
from plinth.operators.stats import fit_glm
from plinth.sources.io import ContractError


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; relative error under 1e-12 for x > 0."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


#: Distinct rows of a group beyond which it is dealt in pieces.
PIECE = 50_000


def dealt(rows: DataFrame) -> DataFrame:
    """g, y, x, n (count of equal rows), large: written once, a group that is not large in one partition and one run of it."""
    counted = rows.groupBy("g", "y", "x").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > PIECE).select(F.col("g").alias("_big"))
    placed = counted.join(sizes, F.col("g") == F.col("_big"), "left").withColumn("large", F.col("_big").isNotNull()).drop("_big")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.when(F.col("large"), F.pmod(F.xxhash64("y", "x"), F.lit(1 << 20))).otherwise(0)
    return cut(placed.repartition(parts, "g", piece).sortWithinPartitions("g"))


def log_likelihoods(rows: DataFrame, vectors: np.ndarray, p: int, family: str, nodes: int) -> np.ndarray:
    """Marginal log likelihood of each parameter vector (coefficients, log sd, log theta) over what `dealt` gives."""
    at, weight = np.polynomial.hermite_e.hermegauss(nodes)
    log_w = np.log(weight / math.sqrt(2 * math.pi))
    n = len(vectors)

    def marginal(sums: np.ndarray) -> np.ndarray:
        """Vectors: sum over groups; `sums` are groups x vectors x nodes."""
        s = sums + log_w
        top = s.max(axis=2)
        return (top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))).sum(axis=0)

    def group_sums(y: np.ndarray, x: np.ndarray, count: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        values, ways = np.unique(y, return_inverse=True)
        out = np.empty((len(firsts), n, nodes))
        for i, v in enumerate(vectors):
            eta = (x @ v[:p])[:, None] + math.exp(v[p]) * at[None, :]
            if family == "binomial":
                terms = y[:, None] * eta - np.logaddexp(0, eta)
            else:
                theta, mu = math.exp(v[p + 1]), np.exp(np.minimum(eta, 50))
                fixed = log_gamma(values + theta) - log_gamma(np.array(theta)) - log_gamma(values + 1)
                terms = fixed[ways.ravel()][:, None] + theta * np.log(theta / (theta + mu)) + y[:, None] * np.log(mu / (theta + mu) + 1e-300)
            out[:, i] = np.add.reduceat(terms * count[:, None], firsts, axis=0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, last = np.zeros(n), np.zeros((1, n, nodes)), None  # the group that a batch's end may have cut
        pieces: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch["g"].dictionary_encode()
            g, large = codes.indices.to_numpy(), batch["large"].to_numpy(zero_copy_only=False)
            firsts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            x = batch["x"].flatten().to_numpy().reshape(-1, p)
            sums = group_sums(batch["y"].to_numpy(), x, batch["n"].to_numpy().astype(float), firsts)
            names, kinds = codes.dictionary.take(pa.array(g[firsts])).to_pylist(), large[firsts]
            for i in np.flatnonzero(kinds):
                pieces[names[i]] = pieces.get(names[i], 0) + sums[i]
            small = np.flatnonzero(~kinds)
            if not len(small):
                continue
            if last is not None and names[small[0]] == last:
                sums[small[0]] += waiting[0]
            elif last is not None:
                total += marginal(waiting)
            last, waiting = names[small[-1]], sums[small[-1:]]
            total += marginal(sums[small[:-1]]) if len(small) > 1 else 0.0
        total += marginal(waiting) if last is not None else 0.0
        out = [(None, total.tolist()), *[(k, v.ravel().tolist()) for k, v in pieces.items()]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.list_(pa.float64()))], names=["g", "s"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, s in zip(batch["g"].to_pylist(), batch["s"].to_pylist()):
                done = np.array(s) if g is None else marginal(np.reshape(s, (1, n, nodes)))
                yield pa.RecordBatch.from_arrays([pa.array([done.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.mapInArrow(run, "g string, s array<double>").select("g", F.posexplode("s").alias("at", "v")).groupBy("g", "at").agg(F.sum("v").alias("v"))
    joined = parts.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("s"))
    totals = joined.mapInArrow(whole, "s array<double>").select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(n)
    for r in totals.collect():  # a number for each vector
        out[r["at"]] = r["v"]
    return out


def fit_mixed(df: DataFrame, outcome: str, covariates: Sequence[str], group: str, family: str = "binomial", nodes: int = 9, rounds: int = 25, tolerance: float = 1e-5) -> dict[str, object]:
    """Coefficients, errors, sd of the random intercept, theta, log likelihood, and whether it converged.

    Rows with a null are left out. `positive_definite` and `sd` serve the convergence gate:
    an sd at the boundary shows as a very small value.
    """
    known = df.dropna(subset=[outcome, group, *covariates])
    start = fit_glm(known, outcome, covariates, "binomial" if family == "binomial" else "poisson")
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in covariates])
    rows = dealt(known.select(F.col(group).cast("string").alias("g"), F.col(outcome).cast("double").alias("y"), x.alias("x")))
    p = len(covariates) + 1
    v = np.array([*start["coefficients"], math.log(0.5), *([math.log(2.0)] if family != "binomial" else [])])
    q, h = len(v), 1e-3
    unit = np.eye(q) * h
    converged, hessian, best = False, -np.eye(q), -math.inf
    for _ in range(rounds):
        points = [v, *(v + unit), *(v - unit), *[v + unit[i] + unit[j] for i in range(q) for j in range(i)]]
        f = log_likelihoods(rows, np.array(points), p, family, nodes)
        base, up, down = f[0], f[1 : q + 1], f[q + 1 : 2 * q + 1]
        gradient = (up - down) / (2 * h)
        hessian = np.diag((up - 2 * base + down) / h**2)
        at = 2 * q + 1
        for i in range(q):
            for j in range(i):
                hessian[i, j] = hessian[j, i] = (f[at] - up[i] - up[j] + base) / h**2
                at += 1
        best = base
        values, axes = np.linalg.eigh(hessian)
        step = axes @ ((axes.T @ gradient) / np.maximum(np.abs(values), 1e-6))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < tolerance * 10 or gradient @ step < tolerance:
            converged = True
            break
        sizes = np.array([1.0, 0.5, 0.2, 0.05])
        tried = log_likelihoods(rows, np.array([v + s * step for s in sizes]), p, family, nodes)
        if tried.max() <= base:
            converged = bool(gradient @ step < 1e-2)
            break
        v = v + sizes[int(tried.argmax())] * step
        v[p] = max(v[p], -12.0)
    spread = np.linalg.eigvalsh(-hessian)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(-hessian)), 0))[:p]
    return {
        "family": family, "names": ["(intercept)", *covariates], "coefficients": v[:p].tolist(), "errors": errors.tolist(), "sd": float(math.exp(v[p])),
        "theta": float(math.exp(v[p + 1])) if family != "binomial" else None, "log_likelihood": float(best), "converged": converged, "positive_definite": bool(spread.min() > 0), "n": start["n"],
    }


def mixed_gate(fit: dict[str, object], least_sd: float = 1e-4) -> None:
    """Converged to an inner optimum, with a random intercept that varies."""
    if not (fit["converged"] and fit["positive_definite"]):
        raise ContractError("the mixed model did not converge to an inner optimum")
    if fit["sd"] <= least_sd:
        raise ContractError("the random intercept does not vary")


def likelihood_ratio(small: dict[str, object], large: dict[str, object]) -> tuple[float, int, float]:
    """Chi-squared, degrees of freedom and p of nested mixed fits."""
    from plinth.operators.stats import chi2_tail

    x = max(0.0, 2 * (large["log_likelihood"] - small["log_likelihood"]))
    df = len(large["names"]) - len(small["names"])
    return x, df, chi2_tail(x, df)


def intraclass(fit: dict[str, object]) -> float:
    """Latent-scale intraclass correlation of a binomial fit."""
    return fit["sd"] ** 2 / (fit["sd"] ** 2 + math.pi**2 / 3)
