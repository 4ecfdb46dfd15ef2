"""Design matrices: factors with treatment contrasts, products of terms, and aliased columns left out.

A term is a column or a tuple of columns (their product). Columns named as
factors are coded by indicators of every level but the first; levels are found
by one aggregate and are bounded. Columns that are linear combinations of
earlier ones are dropped, found by a Cholesky factorisation of the information
in the order of the columns (one scan). A level that the design has not seen is
an error; a null makes the row's columns null, so that fits leave it out.
Levels are compared as strings; dots in them become `_` in column names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.batch import fit_one, prepared, scan, Request
from plinth.operators.stats import normal_tail
from plinth.sources.io import ContractError

#: A part of a design column: (column, level), or (column, None) for a number.
Part = tuple[str, str | None]


@dataclass(frozen=True)
class Design:
    """Columns of a model: the parts that each is the product of, by name; `dropped` were aliased."""

    columns: dict[str, tuple[Part, ...]]
    levels: dict[str, tuple[str, ...]]
    dropped: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    def value(self, part: Part) -> Column:
        column, level = part
        if level is None:
            return F.col(f"`{column}`").cast("double")
        text = F.col(f"`{column}`").cast("string")
        unseen = F.raise_error(F.concat(F.lit(f"unseen level of {column}: "), text)).cast("double")
        return F.when(text.isNull(), F.lit(None)).when(text.isin(*self.levels[column]), (text == level).cast("double")).otherwise(unseen)

    def apply(self, df: DataFrame) -> DataFrame:
        """`df` plus the design's columns."""
        return df.withColumns({name: math.prod(map(self.value, parts[1:]), start=self.value(parts[0])) for name, parts in self.columns.items()})


def _name(parts: Iterable[Part]) -> str:
    return ":".join(c if level is None else f"{c}={level.replace('.', '_')}" for c, level in parts)


def levels_of(df: DataFrame, factors: Sequence[str], most: int) -> dict[str, tuple[str, ...]]:
    """Levels of each factor, sorted: one aggregate; more than `most` of a factor are an error."""
    if not factors:
        return {}
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("v")) for f in factors])
    found = df.select(F.inline(pairs)).where("v is not null").distinct().limit(most * len(factors) + 1).collect()
    out = {f: tuple(sorted(r["v"] for r in found if r["f"] == f)) for f in factors}
    for f, values in out.items():
        if len(values) > most or len(found) > most * len(factors):
            raise ContractError(f"{f} or another factor has more than {most} levels")
        if not values:
            raise ContractError(f"{f} has no level")
    return out


def model_matrix(df: DataFrame, terms: Sequence[str | Sequence[str]], factors: Sequence[str] = (), most_levels: int = 200, tolerance: float = 1e-9) -> Design:
    """The design of `terms` over `df`, without columns aliased there."""
    levels = levels_of(df, factors, most_levels)
    columns: dict[str, tuple[Part, ...]] = {}
    for term in terms:
        products: list[tuple[Part, ...]] = [()]
        for c in (term,) if isinstance(term, str) else term:
            products = [(*p, (c, level)) for level in (levels[c][1:] if c in levels else (None,)) for p in products]
        columns |= {_name(p): p for p in products}
    whole = Design(columns, levels)
    rows = prepared(whole.apply(df).withColumn("_one", F.lit(1)), "_one", whole.names, [Request(None, tuple(whole.names))])
    p = len(columns) + 1
    sums, at = scan(rows, np.zeros((1, p)), "gaussian")[0], np.triu_indices(p)
    info = np.zeros((p, p))
    info[at] = info[at[::-1]] = sums[: len(at[0])]
    if not sums[-6]:
        raise ContractError("no complete rows to fit")
    kept = [i - 1 for i in independent(info, tolerance) if i]
    names = whole.names
    return Design({names[i]: columns[names[i]] for i in kept}, levels, tuple(n for i, n in enumerate(names) if i not in kept))


def independent(info: np.ndarray, tolerance: float) -> list[int]:
    """Columns that are no combination of earlier ones: Cholesky with pivots under `tolerance` of the diagonal passed over."""
    scale = np.sqrt(np.where(np.diag(info) > 0, np.diag(info), 1.0))
    a, kept, factor = info / np.outer(scale, scale), [], []
    for i in range(len(a)):
        row = np.zeros(len(kept))
        for k, j in enumerate(kept):
            row[k] = (a[i, j] - row[:k] @ factor[k][:k]) / factor[k][k]
        pivot = a[i, i] - row @ row
        if pivot > tolerance:
            kept.append(i)
            factor.append(np.append(row, math.sqrt(pivot)))
    return kept


def fit_design(df: DataFrame, outcome: str, design: Design, family: str = "gaussian", **more) -> dict[str, object]:
    """A model on the columns of a design, with its covariance."""
    return fit_one(design.apply(df), outcome, design.names, family, **more)


def _link(family: str):
    """(mean, derivative) of a linear predictor."""
    if family == "gaussian":
        return (lambda e: e), (lambda e: np.ones_like(e))
    if family == "binomial":
        mean = lambda e: 1 / (1 + np.exp(-e))
        return mean, (lambda e: mean(e) * (1 - mean(e)))
    return np.exp, np.exp


def averaged(eta: float, family: str, sd: float, nodes: int = 41) -> tuple[float, float]:
    """Mean response and its derivative over a normal random intercept, by Gauss-Hermite quadrature."""
    mean, slope = _link(family)
    at, weight = np.polynomial.hermite_e.hermegauss(nodes if sd else 1)
    e = eta + sd * at
    weight = weight / weight.sum()
    return float(weight @ mean(e)), float(weight @ slope(e))


@dataclass(frozen=True)
class Cells:
    """Marginal means: the design row, linear predictor, error, mean and gradient of each cell."""

    by: tuple[str, ...]
    keys: list[tuple]
    rows: np.ndarray
    eta: np.ndarray
    means: np.ndarray
    gradients: np.ndarray
    covariance: np.ndarray
    family: str


Q95 = 1.959963984540054


def cells(df: DataFrame, fit: Mapping[str, object], design: Design, by: Sequence[str], sd: float = 0.0) -> Cells:
    """All combinations of the levels of the factors `by`, other columns at their means over complete rows.

    With `sd`, means are averaged over a random intercept of that standard deviation.
    """
    missing = [b for b in by if b not in design.levels]
    if missing:
        raise ContractError(f"not a factor of the design: {missing}")
    others = {name: tuple(p for p in parts if p[0] not in by) for name, parts in design.columns.items()}
    products = sorted({p for p in others.values() if p})
    complete = design.apply(df).dropna(subset=design.names)
    sums = [F.avg(math.prod(map(design.value, p[1:]), start=design.value(p[0]))) for p in products]
    means = dict(zip(products, complete.agg(*sums).first())) if sums else {}
    keys: list[tuple] = [()]
    for b in by:
        keys = [(*k, level) for k in keys for level in design.levels[b]]
    rows = []
    for key in keys:
        at = dict(zip(by, key))
        hit = [float(all(at[c] == level for c, level in parts if c in at)) * (means[others[name]] if others[name] else 1.0) for name, parts in design.columns.items()]
        rows.append([1.0, *hit])
    x, v = np.array(rows), np.array(fit["covariance"], float)
    eta = x @ np.array(fit["coefficients"], float)
    both = [averaged(e, fit["family"], sd) for e in eta]
    return Cells(tuple(by), keys, x, eta, np.array([m for m, _ in both]), x * np.array([s for _, s in both])[:, None], v, fit["family"])


def marginal_means(df: DataFrame, fit: Mapping[str, object], design: Design, by: Sequence[str], sd: float = 0.0) -> DataFrame:
    """Levels of `by`, cell_mean, low, high and se of the linear predictor.

    Limits are Wald's on the link scale, carried over to the response (and averaged like the mean where `sd` is given).
    """
    c = cells(df, fit, design, by, sd)
    errors = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", c.rows, c.covariance, c.rows), 0))
    ends = [[averaged(e + s * Q95 * se, c.family, sd)[0] for s in (-1, 1)] for e, se in zip(c.eta, errors)]
    rows = [(*key, float(m), *end, float(se)) for key, m, end, se in zip(c.keys, c.means, ends, errors)]
    return df.sparkSession.createDataFrame(rows, ", ".join([*[f"`{b}` string" for b in by], "cell_mean double, low double, high double, se double"]))


def cell_contrasts(df: DataFrame, fit: Mapping[str, object], design: Design, by: Sequence[str], pairs: Sequence[tuple[tuple, tuple]], sd: float = 0.0) -> DataFrame:
    """first, second, difference of their means with limits by the delta method, and z, p_value; ratio (of means on a log
    link, of odds on a logit link; null otherwise) with its limits."""
    c = cells(df, fit, design, by, sd)
    rows = []
    for first, second in pairs:
        i, j = c.keys.index(tuple(first)), c.keys.index(tuple(second))
        g, x = c.gradients[i] - c.gradients[j], c.rows[i] - c.rows[j]
        gap, se = c.means[i] - c.means[j], math.sqrt(max(g @ c.covariance @ g, 0))
        log_ratio, log_se = c.eta[i] - c.eta[j], math.sqrt(max(x @ c.covariance @ x, 0))
        ratio = [None] * 3 if c.family == "gaussian" else [float(math.exp(log_ratio + s * Q95 * log_se)) for s in (0, -1, 1)]
        z = gap / se if se else 0.0
        rows.append((" ".join(first), " ".join(second), float(gap), float(gap - Q95 * se), float(gap + Q95 * se), float(z), normal_tail(z), *ratio))
    kinds = "first string, second string, difference double, low double, high double, z double, p_value double, ratio double, ratio_low double, ratio_high double"
    return df.sparkSession.createDataFrame(rows, kinds)


def robust_covariance(df: DataFrame, fit: Mapping[str, object], outcome: str, cluster: str, small_sample: bool = True) -> dict[str, object]:
    """`fit` with a covariance robust to dependence within clusters (sandwich of score sums by cluster), and n_clusters.

    Scores are added up by cluster with partial sums; only p * (p + 1) / 2 sums of their products come to the driver.
    A null cluster is left out. With `small_sample` the covariance is multiplied by G / (G - 1).
    """
    names = list(fit["names"][1:])
    rows = df.dropna(subset=[outcome, cluster, *names])
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in names]]
    eta = sum((F.lit(float(b)) * c for b, c in zip(fit["coefficients"], x)), F.lit(0.0))
    y, family = F.col(outcome).cast("double"), fit["family"]
    mu = {"gaussian": eta, "binomial": 1 / (1 + F.exp(-eta))}.get(family, F.exp(eta))
    shrink = 1 + mu / F.lit(float(fit["theta"])) if family == "negative_binomial" else F.lit(1.0)
    weight = {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu}.get(family, mu / shrink)
    p, pairs = len(x), [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [F.sum((y - mu) / shrink * c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]
    by_cluster = rows.groupBy(cluster).agg(*sums)
    meat = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]
    got = by_cluster.agg(F.count("*").alias("g"), *meat, *[F.sum(f"h{i}_{j}").alias(f"h{i}_{j}") for i, j in pairs]).first()
    if not got["g"]:
        raise ContractError("no complete rows to fit")
    middle, info = np.zeros((p, p)), np.zeros((p, p))
    for i, j in pairs:
        middle[i, j] = middle[j, i] = got[f"m{i}_{j}"]
        info[i, j] = info[j, i] = got[f"h{i}_{j}"]
    bread = np.linalg.pinv(info)
    v = bread @ middle @ bread * (got["g"] / (got["g"] - 1) if small_sample and got["g"] > 1 else 1.0)
    return {**fit, "covariance": v.tolist(), "errors": np.sqrt(np.maximum(np.diag(v), 0)).tolist(), "n_clusters": int(got["g"])}


def access_difference(df: DataFrame, days: str, offered: Column, arm: Column, cluster: str, horizon: int) -> DataFrame:
    """Difference between arms in the share offered within `horizon` days, with a cluster-robust interval.

    n, n_clusters, access_first (arm false), access_second, difference, low, high, z, p_value. Who is never offered
    counts as not offered; rows without an arm or cluster are left out.
    """
    rows = df.select(F.coalesce((offered & F.col(days).between(0, horizon)).cast("int"), F.lit(0)).alias("hit"), arm.cast("int").alias("arm"), F.col(cluster).alias("cluster")).dropna()
    fit = robust_covariance(rows, fit_one(rows, "hit", ["arm"], "gaussian"), "hit", "cluster")
    b, gap, se = *fit["coefficients"], fit["errors"][1]
    z = gap / se if se else 0.0
    row = (fit["n"], fit["n_clusters"], b, b + gap, gap, gap - Q95 * se, gap + Q95 * se, z, normal_tail(z))
    return df.sparkSession.createDataFrame([row], "n long, n_clusters long, access_first double, access_second double, difference double, low double, high double, z double, p_value double")
