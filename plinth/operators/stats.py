"""Tests and models: aggregates in Spark, closed forms on the few numbers they give."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.batch import Request, fit_many
from plinth.operators.ranges import sum_before
from plinth.operators.windows import average_ranks, hashed
from plinth.sources.io import ContractError


def normal_tail(z: float) -> float:
    """Two-sided tail probability."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int = 1) -> float:
    """Upper tail of chi-squared, by the regularised incomplete gamma series and continued fraction."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a)))
    b, c = y + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * math.exp(-y + a * math.log(y) - math.lgamma(a))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a two-by-two table: the sum of all tables no likelier than this one.

    Tables are summed from the likeliest one and from this one's counterpart outward until terms vanish, so the
    work grows with the spread of the counts (their square root), not with the counts.
    """
    r1, r2, k = a + b, c + d, a + c
    low, high = max(0, k - r2), min(r1, k)
    log_p = lambda x: -sum(map(math.lgamma, (x + 1, r1 - x + 1, k - x + 1, r2 - k + x + 1)))
    mode = min(high, max(low, (r1 + 1) * (k + 1) // (r1 + r2 + 2)))
    top, here = log_p(mode), log_p(a)

    def outward(start: int, step: int) -> float:
        """The sum of terms from start on, relative to the mode; they fall all the way."""
        total, x = 0.0, start
        while low <= x <= high:
            term = math.exp(log_p(x) - top)
            total += term
            if term < total * 1e-17 or term < 1e-300:
                break
            x += step
        return total

    def first_beyond(step: int) -> int:
        """The nearest table on one side of the mode that is no likelier than this one, by bisection."""
        near, far = mode, (high if step > 0 else low) + step  # near may be likelier, far is not
        while abs(far - near) > 1:
            middle = (near + far) // 2
            near, far = (near, middle) if log_p(middle) <= here + 1e-7 else (middle, far)
        return far

    if top <= here + 1e-7:
        return 1.0
    whole = outward(mode, 1) + outward(mode - 1, -1)
    return min(1.0, (outward(first_beyond(1), 1) + outward(first_beyond(-1), -1)) / whole)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact p of k successes in n at one half."""
    if not n:
        return 1.0
    lesser = min(k, n - k)
    log_c = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    total = 0.0
    for i in range(lesser, -1, -1):  # terms fall, so the sum ends where they vanish
        term = math.exp(log_c(i))
        total += term
        if term <= total * 1e-17:
            break
    return min(1.0, 2 * total - (math.exp(log_c(lesser)) if 2 * lesser == n else 0.0))


def table_2x2(df: DataFrame, arm: Column, outcome: Column) -> tuple[int, int, int, int]:
    """Counts (arm and outcome, arm only, outcome only, neither) of rows where both are known."""
    known = df.where(arm.isNotNull() & outcome.isNotNull())
    r = known.agg(F.count_if(arm & outcome), F.count_if(arm & ~outcome), F.count_if(~arm & outcome), F.count_if(~arm & ~outcome)).first()
    return tuple(int(x) for x in r)


def two_proportions(df: DataFrame, arm: Column, outcome: Column, correct: bool = True) -> DataFrame:
    """Both proportions, the continuity-corrected chi-squared and its p."""
    a, b, c, d = table_2x2(df, arm, outcome)
    n1, n2 = a + b, c + d
    if not n1 or not n2:
        raise ContractError("an arm is empty")
    n, gap = n1 + n2, abs(a / n1 - c / n2)
    pooled = (a + c) / n
    yates = min(0.5, gap / (1 / n1 + 1 / n2)) if correct else 0.0
    se = math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    chi2 = ((gap - yates * (1 / n1 + 1 / n2)) / se) ** 2 if se else 0.0
    return df.sparkSession.createDataFrame([(a / n1, c / n2, chi2, chi2_tail(chi2))], "p1 double, p2 double, chi2 double, p_value double")


def mcnemar(df: DataFrame, pair: str, first: str, second: str) -> DataFrame:
    """Discordant pairs, the exact p and the risk difference; `first` and `second` are boolean columns of one row for each pair."""
    x, y = F.col(first), F.col(second)
    n, b, c = df.where(x.isNotNull() & y.isNotNull()).agg(F.count("*"), F.count_if(x & ~y), F.count_if(~x & y)).first()
    return df.sparkSession.createDataFrame([(n, b, c, binomial_two_sided(b, b + c), (b - c) / n if n else None)], "n_pairs long, only_first long, only_second long, p_value double, risk_difference double")


def rank_sum(df: DataFrame, value: str, arm: Column) -> DataFrame:
    """Wilcoxon rank sum with mid-ranks, tie and continuity correction; infinity is a value like any other."""
    ranked = average_ranks(df.where(arm.isNotNull()).withColumn("_arm", arm), value)
    ties = ranked.select(value, "n_ties").distinct().agg(F.sum(F.pow(F.col("n_ties").cast("double"), 3) - F.col("n_ties"))).first()[0] or 0.0
    n1, n2, r1 = ranked.agg(F.count_if("_arm"), F.count_if(~F.col("_arm")), F.sum(F.when(F.col("_arm"), F.col("avg_rank")))).first()
    if not n1 or not n2:
        raise ContractError("an arm is empty")
    u, n = r1 - n1 * (n1 + 1) / 2, n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    off = u - n1 * n2 / 2
    z = (off - math.copysign(0.5, off)) / sd if off and sd else 0.0
    return df.sparkSession.createDataFrame([(int(n1), int(n2), float(u), z, normal_tail(z))], "n1 long, n2 long, u double, z double, p_value double")


def ks_distance(df: DataFrame, value: str, cdf) -> DataFrame:
    """One-sample Kolmogorov-Smirnov D of a column against a distribution function on Columns, over distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    summed = sum_before(counts, [value], "_n", "_before").withColumn("_upto", F.col("_before") + F.col("_n"))
    total = summed.agg(F.sum("_n").alias("_total"))
    steps = summed.crossJoin(F.broadcast(total))  # one row of totals
    p = cdf(F.col(value))
    gap = F.greatest(F.abs(F.col("_upto") / F.col("_total") - p), F.abs(p - (F.col("_upto") - F.col("_n")) / F.col("_total")))
    return steps.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("d"), F.coalesce(F.max("_total"), F.lit(0)).alias("n"))


def ks_p(d: float, n: int) -> float:
    """Kolmogorov's series with the usual small-sample scaling; near 0, where it does not converge, the one of its theta function."""
    if n <= 0 or d <= 0:
        return 1.0
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if t < 1:
        below = sum(math.exp(-(((2 * k - 1) * math.pi) ** 2) / (8 * t * t)) for k in range(1, 6)) if t > 0.05 else 0.0
        return 1 - math.sqrt(2 * math.pi) / t * below
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def uniform_cdf(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def normal_cdf(c: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Abramowitz and Stegun's approximation 7.1.26 of the error function; absolute error under 1.5e-7."""
    z = (c - mean) / (sd * math.sqrt(2))
    t = 1 / (1 + 0.3275911 * F.abs(z))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = F.signum(z) * (1 - poly * F.exp(-z * z))
    return (1 + erf) / 2


def access_curve(df: DataFrame, by: Sequence[str], days: str, offered: Column, horizon: int) -> DataFrame:
    """Share of each group offered within t days, for t from 0 to the horizon."""
    hits = df.groupBy(*by, F.when(offered & F.col(days).between(0, horizon), F.col(days).cast("int")).alias("_d")).agg(F.count("*").alias("_n"))
    totals = hits.groupBy(*by).agg(F.sum("_n").alias("n"))
    grid = totals.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("day"))
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # horizon + 1 rows
    daily = grid.join(hits.where("_d is not null").withColumnRenamed("_d", "day"), [*by, "day"], "left")
    return daily.select(*by, "day", "n", (F.sum(F.coalesce("_n", F.lit(0))).over(w) / F.col("n")).alias("access"))


def design(df: DataFrame, covariates: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]


def fit_glm(df: DataFrame, outcome: str, covariates: Sequence[str], family: str = "binomial", theta: float | None = None, rounds: int = 50, tolerance: float = 1e-9, weight: str | None = None) -> dict[str, object]:
    """Iteratively reweighted least squares; each round is one aggregate of p * (p + 3) / 2 sums.

    Families: gaussian (identity), binomial (logit), poisson and negative_binomial (log). Rows with a null are
    left out. Returns names, coefficients, errors, deviance-free fit figures and whether it converged.
    """
    rows = df.dropna(subset=[outcome, *covariates])
    x, y = design(rows, covariates), F.col(outcome).cast("double")
    w0 = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = len(x)
    beta = np.zeros(p)
    if family in ("poisson", "negative_binomial"):
        beta[0] = math.log(max(rows.agg(F.avg(y)).first()[0] or 1.0, 1e-6))
    converged, info, n = False, np.eye(p), 0
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        if family == "gaussian":
            mu, w, z = eta, w0, y
        elif family == "binomial":
            mu = 1 / (1 + F.exp(-eta))
            v = F.greatest(mu * (1 - mu), F.lit(1e-10))
            w, z = w0 * v, eta + (y - mu) / v
        else:
            mu = F.exp(F.least(eta, F.lit(50.0)))
            w = w0 * (mu if family == "poisson" else mu / (1 + mu / F.lit(float(theta))))
            z = eta + (y - mu) / mu
        sums = [F.sum(w * x[i] * x[j]) for i in range(p) for j in range(i, p)] + [F.sum(w * x[i] * z) for i in range(p)] + [F.count("*")]
        got = rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        if not got[-1]:
            raise ContractError("no complete rows to fit")
        info, n = np.zeros((p, p)), int(got[-1])
        at = 0
        for i in range(p):
            for j in range(i, p):
                info[i, j] = info[j, i] = got[at]
                at += 1
        new = np.linalg.solve(info + 1e-12 * np.eye(p), np.array(got[at : at + p], float))
        step = float(np.abs(new - beta).max())
        beta = new
        if step < tolerance * (1 + float(np.abs(beta).max())) or family == "gaussian":
            converged = True
            break
    scale = 1.0
    if family == "gaussian":
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        scale = rows.agg(F.sum(F.pow(y - eta, 2))).first()[0] / max(n - p, 1)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.inv(info + 1e-12 * np.eye(p))) * scale, 0))
    positive = bool(np.linalg.eigvalsh(info).min() > 0)
    return {"family": family, "names": ["(intercept)", *covariates], "coefficients": beta.tolist(), "errors": errors.tolist(), "n": n, "converged": converged, "positive_definite": positive, "theta": theta}


def linear_predictor(fit: dict[str, object], covariates: Sequence[str]) -> Column:
    return sum((F.lit(float(b)) * c for b, c in zip(fit["coefficients"], [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]])), F.lit(0.0))


def predict(df: DataFrame, fit: dict[str, object], name: str = "predicted") -> DataFrame:
    """Response-scale predictions; null where a covariate is."""
    eta = linear_predictor(fit, fit["names"][1:])
    mu = {"gaussian": eta, "binomial": 1 / (1 + F.exp(-eta))}.get(fit["family"], F.exp(eta))
    return df.withColumn(name, mu)


def pearson_dispersion(df: DataFrame, fit: dict[str, object], outcome: str) -> float:
    """Pearson chi-squared over residual degrees of freedom."""
    rows = predict(df.dropna(subset=[outcome, *fit["names"][1:]]), fit, "_mu")
    mu = F.col("_mu")
    variance = {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu}.get(fit["family"])
    if variance is None:
        variance = mu + mu * mu / F.lit(float(fit["theta"]))
    total = rows.agg(F.sum(F.pow(F.col(outcome) - mu, 2) / variance)).first()[0] or 0.0
    return float(total) / max(fit["n"] - len(fit["names"]), 1)


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by eight, for x > 0."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    shift = sum((F.log(x + k) for k in range(8)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x: Column) -> Column:
    """First derivative of `log_gamma`."""
    z = x + 8
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, 4)) - 1 / (252 * F.pow(z, 6)) + 1 / (240 * F.pow(z, 8))
    return series - sum((1 / (x + k) for k in range(8)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    """Second derivative of `log_gamma`."""
    z = x + 8
    series = 1 / z + 1 / (2 * z * z) + 1 / (6 * F.pow(z, 3)) - 1 / (30 * F.pow(z, 5)) + 1 / (42 * F.pow(z, 7)) - 1 / (30 * F.pow(z, 9))
    return series + sum((1 / F.pow(x + k, 2) for k in range(8)), F.lit(0.0))


def row_log_likelihood(family: str, y: Column, mu: Column, theta: float | Column | None = None) -> Column:
    """A row's log likelihood in a binomial (0/1), Poisson or negative binomial model."""
    if family == "binomial":
        return y * F.log(mu) + (1 - y) * F.log(1 - mu)
    if family == "poisson":
        return y * F.log(mu) - mu - log_gamma(y + 1)
    if family == "negative_binomial":
        t = theta if isinstance(theta, Column) else F.lit(float(theta))
        return log_gamma(y + t) - log_gamma(t) - log_gamma(y + 1) + t * F.log(t / (t + mu)) + y * F.log(mu / (t + mu))
    raise ValueError(f"no likelihood of {family}")


def log_likelihood(df: DataFrame, fit: dict[str, object], outcome: str) -> float:
    """The log likelihood of a fit over complete rows."""
    rows = predict(df.dropna(subset=[outcome, *fit["names"][1:]]), fit, "_mu")
    return float(rows.agg(F.sum(row_log_likelihood(fit["family"], F.col(outcome).cast("double"), F.col("_mu"), fit["theta"]))).first()[0] or 0.0)


def fit_negative_binomial(df: DataFrame, outcome: str, covariates: Sequence[str], rounds: int = 20, most_theta: float = 1e6) -> dict[str, object]:
    """Negative binomial (log link) by maximum likelihood.

    Coefficients and log theta move together, one scan for each round: Fisher scoring for the coefficients, Newton for
    log theta (the two are uncorrelated). Counts without overdispersion run into `most_theta`, which is a Poisson model.
    """
    fit = fit_glm(df, outcome, covariates, "poisson")
    rows = df.dropna(subset=[outcome, *covariates])
    x, y = design(rows, covariates), F.col(outcome).cast("double")
    p, beta = len(x), np.array(fit["coefficients"])
    over = predict(rows, fit, "_mu").agg(F.sum(F.pow(F.col("_mu"), 2)), F.sum(F.pow(y - F.col("_mu"), 2) - F.col("_mu"))).first()
    log_theta = math.log(min(max(over[0] / over[1], 1e-3), most_theta)) if over[1] and over[1] > 0 else math.log(most_theta)
    converged, info, log_l = False, np.eye(p), 0.0
    for _ in range(rounds):
        theta = math.exp(log_theta)
        t = F.lit(theta)
        mu = F.exp(F.least(sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0)), F.lit(50.0)))
        w = mu / (1 + mu / t)
        score = digamma(y + t) - digamma(t) + F.log(t / (t + mu)) + 1 - (y + t) / (t + mu)
        bend = trigamma(y + t) - trigamma(t) + 1 / t - 2 / (t + mu) + (y + t) / F.pow(t + mu, 2)
        sums = [F.sum(w * x[i] * x[j]) for i in range(p) for j in range(i, p)] + [F.sum(x[i] * (y - mu) / (1 + mu / t)) for i in range(p)]
        sums += [F.sum(score), F.sum(bend), F.sum(row_log_likelihood("negative_binomial", y, mu, theta))]
        got = rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        at = 0
        for i in range(p):
            for j in range(i, p):
                info[i, j] = info[j, i] = got[at]
                at += 1
        step = np.linalg.solve(info + 1e-12 * np.eye(p), np.array(got[at : at + p], float))
        slope, curve = theta * got[-3], theta * theta * got[-2] + theta * got[-3]
        move = -slope / curve if curve < 0 else math.copysign(0.5, slope)
        beta, log_l = beta + step, float(got[-1])
        before, log_theta = log_theta, min(max(log_theta + max(-1.0, min(1.0, move)), math.log(1e-6)), math.log(most_theta))
        if np.abs(step).max() < 1e-8 * (1 + np.abs(beta).max()) and abs(log_theta - before) < 1e-7:
            converged = True
            break
    errors = np.sqrt(np.maximum(np.diag(np.linalg.inv(info + 1e-12 * np.eye(p))), 0))
    return {**fit, "family": "negative_binomial", "coefficients": beta.tolist(), "errors": errors.tolist(), "theta": math.exp(log_theta), "log_likelihood": log_l, "converged": converged, "positive_definite": bool(np.linalg.eigvalsh(info).min() > 0)}


def nested_test(df: DataFrame, small: dict[str, object], large: dict[str, object], outcome: str) -> DataFrame:
    """Likelihood-ratio test of two fits of one family, over the rows that are complete for the larger one."""
    rows = df.dropna(subset=[outcome, *large["names"][1:]])
    x = max(0.0, 2 * (log_likelihood(rows, large, outcome) - log_likelihood(rows, small, outcome)))
    k = len(large["names"]) - len(small["names"])
    return df.sparkSession.createDataFrame([(x, k, chi2_tail(x, k))], "chi2 double, df int, p_value double")


def nested_counts_test(df: DataFrame, outcome: str, large: Sequence[str], small: Sequence[str], family: str = "poisson") -> DataFrame:
    """`nested_test` of two fits over the rows complete for the larger one, which are counted by pattern first and share their scans."""
    counted = df.dropna(subset=[outcome, *large]).groupBy(*[F.col(f"`{c}`") for c in (outcome, *large)]).agg(F.count("*").alias("_n"))
    fits = fit_many(counted, outcome, [Request(F.col("_n"), tuple(large)), Request(F.col("_n"), tuple(small))], family)
    x, k = max(0.0, 2 * (fits[0]["log_likelihood"] - fits[1]["log_likelihood"])), len(large) - len(small)
    return df.sparkSession.createDataFrame([(x, k, chi2_tail(x, k))], "chi2 double, df int, p_value double")


def compare_families(df: DataFrame, outcome: str, covariates: Sequence[str]) -> DataFrame:
    """family, log_likelihood, aic, dispersion and the expected and observed share of zeros of count models."""
    rows = df.dropna(subset=[outcome, *covariates])
    zero = rows.agg(F.avg((F.col(outcome) == 0).cast("int"))).first()[0]
    out = []
    for fit in (fit_glm(rows, outcome, covariates, "poisson"), fit_negative_binomial(rows, outcome, covariates)):
        log_l, mu = log_likelihood(rows, fit, outcome), F.col("_mu")
        none = F.exp(-mu) if fit["family"] == "poisson" else F.pow(F.lit(fit["theta"]) / (F.lit(fit["theta"]) + mu), F.lit(fit["theta"]))
        expected = predict(rows, fit, "_mu").agg(F.avg(none)).first()[0]
        parameters = len(fit["names"]) + (fit["family"] != "poisson")
        out.append((fit["family"], log_l, 2 * parameters - 2 * log_l, pearson_dispersion(rows, fit, outcome), float(expected), float(zero)))
    return df.sparkSession.createDataFrame(out, "family string, log_likelihood double, aic double, dispersion double, expected_zeros double, observed_zeros double")


def spline_knots(df: DataFrame, column: str, shares: Sequence[float] = (0.1, 0.5, 0.9)) -> list[float]:
    """Knots at quantiles of a column, from a mergeable sketch (ranks within 1/10,000); equal ones count once."""
    got = df.agg(F.percentile_approx(F.col(column).cast("double"), [float(s) for s in shares], 10_000)).first()[0] or []
    knots = sorted(set(got))
    if len(knots) < 3:
        raise ContractError(f"{column} has too few different values for a spline")
    return knots


def spline_terms(column: str, knots: Sequence[float]) -> dict[str, Column]:
    """Natural cubic spline terms, one fewer than knots: linear beyond the outer knots, by truncated powers scaled by the range."""
    x, last, width = F.col(column).cast("double"), knots[-1], knots[-1] - knots[0]

    def above(k: float) -> Column:
        return F.pow(F.greatest(x - k, F.lit(0.0)), 3)

    def bend(k: float) -> Column:
        return (above(k) - above(last)) / ((last - k) * width)

    terms = {f"{column}_s1": x}
    # greatest() would pass over a null
    terms |= {f"{column}_s{j}": F.when(x.isNotNull(), bend(k) - bend(knots[-2])) for j, k in enumerate(knots[:-2], 2)}
    return terms


def fit_spline(df: DataFrame, outcome: str, column: str, covariates: Sequence[str] = (), family: str = "binomial", knots: Sequence[float] | None = None) -> tuple[DataFrame, dict[str, object]]:
    """`df` with the spline terms of a column, and the model on them and other covariates.

    The first term is the column itself: `nested_test` of a fit on it alone tells whether the rest bends.
    Knots come from the rows the model is fitted on.
    """
    knots = list(knots) if knots else spline_knots(df.dropna(subset=[outcome, column, *covariates]), column)
    terms = spline_terms(column, knots)
    rows = df.withColumns(terms)
    return rows, {**fit_glm(rows, outcome, [*terms, *covariates], family), "knots": knots}


def fit_zero_inflated(df: DataFrame, outcome: str, covariates: Sequence[str] = (), rounds: int = 50) -> dict[str, object]:
    """Zero-inflated Poisson (log link, one share of extra zeros) by maximum likelihood; one scan for each round.

    Newton steps for coefficients and the log odds of the share move together, along eigenvectors with their curvature
    made positive and halved (in the scan of the next round) when the likelihood fell. Counts without extra zeros run to a share near 0.
    """
    rows = df.dropna(subset=[outcome, *covariates])
    x, y = design(rows, covariates), F.col(outcome).cast("double")
    p = len(x)
    start = fit_glm(rows, outcome, covariates, "poisson")
    none = F.avg((y == 0).cast("int"))
    zeros = float(rows.agg(none).first()[0])
    expected = float(predict(rows, start, "_mu").agg(F.avg(F.exp(-F.col("_mu")))).first()[0])
    share = min(max((zeros - expected) / max(1 - expected, 1e-9), 0.01), 0.95)
    v = np.array([*start["coefficients"], math.log(share / (1 - share))])
    v[0] -= math.log(1 - share)
    here, best, step, converged, info = None, -math.inf, np.zeros(p + 1), False, np.eye(p + 1)
    for _ in range(rounds):
        pi = 1 / (1 + math.exp(-v[p]))
        eta = F.least(sum((F.lit(float(b)) * c for b, c in zip(v, x)), F.lit(0.0)), F.lit(50.0))
        mu, zero = F.exp(eta), y == 0
        all_zero = F.lit(pi) + (1 - pi) * F.exp(-mu)
        count = F.when(zero, (1 - pi) * F.exp(-mu) / all_zero).otherwise(1.0)  # chance that the row is of the Poisson part
        mixed = F.when(zero, count * (1 - count)).otherwise(0.0)
        slopes = [F.sum(F.when(zero, -mu * count).otherwise(y - mu) * c) for c in x] + [F.sum((1 - count) - pi)]
        within = mu * count - mu * mu * mixed
        bends = [F.sum(within * x[i] * x[j]) for i in range(p) for j in range(i, p)]
        bends += [F.sum(-mu * mixed * c) for c in x] + [F.sum(pi * (1 - pi) - mixed)]
        log_l = F.sum(F.when(zero, F.log(all_zero)).otherwise(math.log1p(-pi) + y * eta - mu - log_gamma(y + 1)))
        got = rows.agg(*[s.alias(f"s{k}") for k, s in enumerate([*slopes, *bends, log_l])]).first()
        if got[-1] < best - 1e-9 * abs(best):
            step = step / 2
            v = here + step
            continue
        gained, here, best = got[-1] - best, v, got[-1]
        info, at = np.zeros((p + 1, p + 1)), p + 1
        for i in range(p):
            for j in range(i, p):
                info[i, j] = info[j, i] = got[at]
                at += 1
        info[p, :p] = info[:p, p] = got[at : at + p]
        info[p, p] = got[at + p]
        values, axes = np.linalg.eigh(info)
        step = axes @ ((axes.T @ np.array(got[: p + 1], float)) / np.maximum(np.abs(values), 1e-9))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7 * (1 + np.abs(v).max()) or (v[p] < -12 and gained < 1e-6):
            converged = True
            break
        v = here + step
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0))
    return {
        "family": "zero_inflated_poisson", "names": ["(intercept)", *covariates], "coefficients": here[:p].tolist(), "errors": errors[:p].tolist(), "extra_zeros": 1 / (1 + math.exp(-here[p])),
        "log_likelihood": float(best), "poisson_log_likelihood": log_likelihood(rows, start, outcome), "n": start["n"], "converged": converged, "positive_definite": bool(np.linalg.eigvalsh(info).min() > 0), "theta": None,
    }


def recalibration(df: DataFrame, fit: dict[str, object], outcome: str) -> DataFrame:
    """Intercept and slope of the outcome on the linear predictor of a binomial fit: 0 and 1 for a fit that carries over."""
    rows = df.dropna(subset=[outcome, *fit["names"][1:]]).withColumn("_eta", linear_predictor(fit, fit["names"][1:]))
    again = fit_glm(rows, outcome, ["_eta"], "binomial")
    return df.sparkSession.createDataFrame([(*again["coefficients"], again["n"])], "intercept double, slope double, n long")


def _by_fit(fits: Sequence[dict[str, object]], which: Column) -> Column:
    """Linear predictor of a row by the fit whose number is `which`."""
    return F.get(F.array(*[linear_predictor(f, f["names"][1:]) for f in fits]), which)


def _mean_of(family: str, eta: Column) -> Column:
    return {"gaussian": eta, "binomial": 1 / (1 + F.exp(-eta))}.get(family, F.exp(eta))


def cross_validated(df: DataFrame, outcome: str, covariates: Sequence[str], cluster: str, k: int, seed: int = 0, family: str = "binomial") -> DataFrame:
    """Each fold's rows scored by the fit of the others; a cluster is in one fold, and all k fits share their scans.

    fold, n and, for a binomial model, brier; for others rmse, mae and mean_log_likelihood (null for gaussian).
    """
    rows = df.dropna(subset=[outcome, cluster, *covariates]).withColumn("_fold", folds(cluster, k, seed))
    fits = fit_many(rows, outcome, [Request((F.col("_fold") != f).cast("int"), tuple(covariates)) for f in range(k)], family)
    scored = rows.select("_fold", F.col(outcome).cast("double").alias("_y"), _mean_of(family, _by_fit(fits, F.col("_fold"))).alias("_p"))
    gap = F.col("_y") - F.col("_p")
    if family == "binomial":
        measures = [F.avg(gap * gap).alias("brier")]
    else:
        thetas = F.get(F.array(*[F.lit(f["theta"] or 0.0) for f in fits]), F.col("_fold"))
        log_l = F.lit(None).cast("double") if family == "gaussian" else row_log_likelihood(family, F.col("_y"), F.col("_p"), thetas)
        measures = [F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.avg(log_l).alias("mean_log_likelihood")]
    return scored.groupBy(F.col("_fold").alias("fold")).agg(F.count("*").alias("n"), *measures)


def temporal_validation(df: DataFrame, outcome: str, covariates: Sequence[str], later: Column, family: str = "negative_binomial") -> DataFrame:
    """A fit of the earlier rows held against the `later` ones: n_train, n_test, rmse, mae, bias (mean predicted - observed), intercept and slope.

    The last two are the recalibration of the outcome on the linear predictor: 0 and 1 for a fit that carries over.
    """
    rows = df.dropna(subset=[outcome, *covariates])
    fit = fit_many(rows, outcome, [Request((~later).cast("int"), tuple(covariates))], family)[0]
    test = rows.where(later).withColumn("_eta", linear_predictor(fit, covariates))
    gap = _mean_of(family, F.col("_eta")) - F.col(outcome)
    n, rmse, mae, bias = test.agg(F.count("*"), F.sqrt(F.avg(gap * gap)), F.avg(F.abs(gap)), F.avg(gap)).first()
    if not n:
        raise ContractError("no later rows")
    again = fit_many(test, outcome, [Request(None, ("_eta",))], "poisson" if family == "negative_binomial" else family)[0]["coefficients"]
    return df.sparkSession.createDataFrame([(fit["n"], n, rmse, mae, bias, *again)], "n_train long, n_test long, rmse double, mae double, bias double, intercept double, slope double")


#: Distribution function of Poisson(1) at 0..7.
_POISSON_ONE = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)]


def drawn(keys: Sequence[str], draws: int) -> Column:
    """`poisson_weight` of all draws as an array of bytes: one hash for each draw."""
    of_row = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in keys]
    digest = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.md5(F.concat_ws("|", k.cast("string"), *of_row)))
    u = F.transform(digest, lambda h: (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32))
    return F.transform(u, lambda v: sum(((v > p).cast("int") for p in _POISSON_ONE), F.lit(0)).cast("tinyint"))


def with_draws(df: DataFrame, keys: Sequence[str], draws: int) -> DataFrame:
    """`df` plus `_draws`, the weights of all draws, hashed once for each cluster and not for each of its rows."""
    names = [f"_d{i}" for i in range(len(keys))]
    text = {n: F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for n, k in zip(names, keys)}
    rows = df.withColumns(text)
    return rows.join(rows.select(*names).distinct().withColumn("_draws", drawn(names, draws)), names).drop(*names)


def bootstrap(df: DataFrame, outcome: str, covariates: Sequence[str], keys: Sequence[str], draws: int, family: str = "binomial") -> DataFrame:
    """draw, term, estimate: fits under Poisson weights of the rows' clusters `keys`; all draws share their scans."""
    fits = fit_many(with_draws(df, keys, draws), outcome, [Request(None, tuple(covariates))] * draws, family, draws=F.col("_draws"))
    out = [(draw, name, b) for draw, fit in enumerate(fits) for name, b in zip(fit["names"], fit["coefficients"])]
    return df.sparkSession.createDataFrame(out, "draw int, term string, estimate double")


def retention(df: DataFrame, outcome: str, covariates: Sequence[str], keys: Sequence[str], draws: int = 50, below: float = 0.1, family: str = "binomial") -> DataFrame:
    """term, n_draws, n_kept, share: draws in which a covariate's p stays under `below`, of those that converged."""
    every = fit_many(with_draws(df, keys, draws), outcome, [Request(None, tuple(covariates))] * draws, family, draws=F.col("_draws"))
    fits = [f for f in every if f["converged"]]
    kept = {name: sum(normal_tail(f["coefficients"][i] / f["errors"][i]) < below for f in fits if f["errors"][i]) for i, name in enumerate(covariates, 1)}
    rows = [(name, len(fits), n, n / len(fits) if fits else None) for name, n in kept.items()]
    return df.sparkSession.createDataFrame(rows, "term string, n_draws int, n_kept int, share double")


def effects(df: DataFrame, fit: dict[str, object], exponentiate: bool = True) -> DataFrame:
    """term, estimate, low, high, z, p_value; intervals are Wald's on the link scale."""
    f = math.exp if exponentiate else (lambda v: v)
    q = 1.959963984540054
    rows = []
    for name, b, se in zip(fit["names"], fit["coefficients"], fit["errors"]):
        z = b / se if se else 0.0
        rows.append((name, f(b), f(b - q * se), f(b + q * se), z, normal_tail(z)))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, low double, high double, z double, p_value double")


def cell_means(df: DataFrame, fit: dict[str, object], by: Sequence[str]) -> DataFrame:
    """Predictions over the grid of `by` with the other covariates at their means."""
    others = [c for c in fit["names"][1:] if c not in by]
    means = df.agg(*[F.avg(c).alias(c) for c in others]) if others else None
    grid = df.select(*by).distinct()
    grid = grid.crossJoin(F.broadcast(means)) if means is not None else grid  # one row of means
    return predict(grid, fit, "cell_mean").select(*by, "cell_mean")


def overdispersion_gate(df: DataFrame, fit: dict[str, object], outcome: str, most: float = 1.5) -> float:
    """Dispersion of a Poisson fit; over `most` is an error. Other families pass."""
    found = pearson_dispersion(df, fit, outcome)
    if fit["family"] == "poisson" and found > most:
        raise ContractError(f"dispersion {found:.3f} is over {most}")
    return found


def convergence_gate(fit: dict[str, object]) -> None:
    if not (fit["converged"] and fit["positive_definite"]):
        raise ContractError("the fit did not converge to an inner optimum")


def variance_components(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between and within variance and the intraclass correlation, by one-way analysis of variance."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count("*"), F.lit(0.0)).alias("ss"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("nn"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"))
    msw = F.try_divide(F.col("ssw"), F.col("nn") - F.col("k"))
    msb = F.try_divide(F.col("nmm") - F.col("nm") * F.col("nm") / F.col("nn"), F.col("k") - 1)
    n0 = F.try_divide(F.col("nn") - F.col("n2") / F.col("nn"), F.col("k") - 1)
    between = F.greatest(F.try_divide(msb - msw, n0), F.lit(0.0))
    return t.select(F.col("k").alias("n_groups"), between.alias("var_between"), msw.alias("var_within"), F.try_divide(between, between + msw).alias("icc"))


def folds(cluster: str, k: int, seed: int = 0) -> Column:
    """Fold 0..k-1 of a cluster; rows of a cluster stay together."""
    return (F.conv(F.substring(hashed(seed, cluster), 1, 8), 16, 10).cast("long") % k).cast("int")


def poisson_weight(*keys: str, draw: int) -> Column:
    """Bootstrap weight of a row in a draw: Poisson(1) from a hash, so draws need no shuffles."""
    u = (F.conv(F.substring(hashed(draw, *keys), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    out, total, p = F.lit(0), 0.0, math.exp(-1)
    for n in range(8):
        total += p
        out = out + F.when(u > total, 1).otherwise(0)
        p /= n + 1
    return out


def caliper_sensitivity(pairs: DataFrame, distance: str, calipers: Sequence[float], **values: Column) -> DataFrame:
    """The same aggregates within each caliper, in one pass."""
    rows = [F.struct(F.lit(float(c)).alias("caliper"), F.count_if(F.col(distance) <= c).alias("n_pairs"), *[F.avg(F.when(F.col(distance) <= c, v)).alias(k) for k, v in values.items()]) for c in calipers]
    return pairs.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def sensitivities(df: DataFrame, variants: Sequence[tuple[str, Column, Sequence[str]]], outcome: str, family: str = "binomial") -> DataFrame:
    """Effects of each named (filter, covariates) variant of a model; all variants share their scans."""
    fits = fit_many(df, outcome, [Request(keep.cast("tinyint"), tuple(covariates)) for _, keep, covariates in variants], family)
    out = None
    for (name, _, _), fit in zip(variants, fits):
        rows = effects(df, fit).select(F.lit(name).alias("variant"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
