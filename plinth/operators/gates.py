"""Data contracts: gates that stop, and row rules that report."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.keys import is_blank
from plinth.operators import stats
from plinth.operators.windows import containment
from plinth.sources.io import ContractError

FINDING = "rule string, detail string, n long"


def _stop(gate: str, why: str) -> None:
    raise ContractError(f"{gate}: {why}")


def check_family(df: DataFrame, column: str, family: str) -> None:
    """Values fit the declared distributional family; one aggregate, and one pass for a uniformity test."""
    if family in ("identifier", "categorical"):
        return
    v = F.col(column).cast("string").try_cast("double")
    r = df.select(v.alias("v")).where("v is not null").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.count_if(F.abs(F.col("v") - F.round("v")) >= 1e-8).alias("broken"),
        F.count_if(F.isnan("v") | (F.abs("v") == float("inf"))).alias("odd"),
    ).first()
    if not r.n:
        _stop("family", f"{column} has no numeric values")
    if family == "proportion" and not (0 <= r.low and r.high <= 100):
        _stop("family", f"{column} is outside 0 to 100")
    elif family == "count" and (r.low < 0 or r.broken):
        _stop("family", f"{column} has negative or broken counts")
    elif family == "continuous" and r.odd:
        _stop("family", f"{column} has {r.odd} values that are not finite")
    elif family == "percentile":
        if not (0 <= r.low and r.high <= 1):
            _stop("family", f"{column} is outside 0 to 1")
        if abs(r.low - 0.01) < 1.5e-8 or abs(r.high - 0.99) < 1.5e-8:
            _stop("family", f"{column} is clamped at 0.01 or 0.99")
        at_low, at_high = df.agg(F.count_if(v == r.low), F.count_if(v == r.high)).first()
        if max(at_low, at_high) / r.n >= 0.02:
            _stop("family", f"{column} piles up on an extreme")
        if r.n >= 30:
            d, n = stats.ks_distance(df.select(v.alias("v")), "v", stats.uniform_cdf).first()
            if stats.ks_p(d, n) <= 0.001:
                _stop("family", f"{column} is not uniform")
    elif family not in ("proportion", "count", "continuous"):
        _stop("family", f"unknown family {family}")


def provenance_gate(df: DataFrame, manifest: Mapping[str, tuple[str, str]], columns: Sequence[str]) -> None:
    """Columns are declared (status, family), present, not simulated, and fit their family."""
    for c in columns:
        if c not in manifest:
            _stop("provenance", f"{c} is not declared")
        if manifest[c][0] == "simulated":
            _stop("provenance", f"{c} is simulated")
        if c not in df.columns:
            _stop("provenance", f"{c} is missing")
        check_family(df, c, manifest[c][1])


def missingness_gate(df: DataFrame, arm: str, columns: Sequence[str], alpha: float = 0.01) -> None:
    """Missing values do not depend on the arm (Fisher's exact test); all or none missing is skipped."""
    arms = sorted(r[0] for r in df.select(arm).where(F.col(arm).isNotNull()).distinct().limit(3).collect())
    if len(arms) != 2:
        _stop("missingness", f"{len(arms)} arms, two needed")
    for c in columns:
        t = stats.table_2x2(df, F.col(arm) == arms[0], F.col(c).isNull())
        if t[0] + t[2] and t[1] + t[3] and (p := stats.fisher_exact(*t)) < alpha:
            _stop("missingness", f"{c} depends on {arm} (p = {p:.3g})")


def population_gate(df: DataFrame, pair: str, arm: str, eligible: str, n_pairs: int | None = None) -> None:
    """All rows are eligible, every pair has one row in each arm, and there are as many pairs as declared."""
    odd = df.groupBy(pair).agg(F.count("*").alias("n"), F.count_distinct(arm).alias("a"), F.bool_and(F.coalesce(F.col(eligible), F.lit(False))).alias("ok"))
    k, bad = odd.agg(F.count("*"), F.count_if(~F.col("ok") | (F.col("n") != 2) | (F.col("a") != 2))).first()
    if bad:
        _stop("population", f"{bad} pairs are not whole or not eligible")
    if n_pairs is not None and k != n_pairs:
        _stop("population", f"{k} pairs, {n_pairs} declared")


def coverage_gate(left: DataFrame, right: DataFrame, key: str, least: float) -> float:
    """Share of left rows whose key the right side has."""
    hits = left.join(right.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    rate = hits.agg(F.avg(F.col("_hit").isNotNull().cast("int"))).first()[0] or 0.0
    if rate < least:
        _stop("coverage", f"{rate:.1%} of rows have a match, {least:.1%} needed")
    return rate


def plan_gate(declared: str, used: str, what: str = "formula") -> None:
    """Equal but for white space."""
    squash = lambda s: " ".join(s.split())
    if squash(declared) != squash(used):
        _stop("plan", f"{what} is {squash(used)!r}, the plan says {squash(declared)!r}")


def constants_gate(constants: Mapping[str, Mapping[str, object]]) -> None:
    """Every constant names its source."""
    bad = [k for k, v in constants.items() if not str(v.get("source") or "").strip()]
    if bad:
        _stop("constants", f"no source for {bad}")


def digest_gate(text: str, expected: str) -> None:
    if hashlib.sha256(text.encode()).hexdigest() != expected:
        _stop("digest", "the plan has changed since its hash was taken")


def plan_drift(df: DataFrame, key: str, declared: str, used: str) -> DataFrame:
    """key of rows whose declared and used texts differ by more than white space; a missing one differs from any text."""
    squash = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    return df.where(~squash(declared).eqNullSafe(squash(used))).select(key)


def unsourced(df: DataFrame, key: str, source: str) -> DataFrame:
    """key of constants that name no source."""
    return df.where(is_blank(F.col(source), trim=True)).select(key)


def digest_drift(df: DataFrame, key: str, text: str, expected: str) -> DataFrame:
    """key of texts whose sha-256 is not the expected one; a missing text or digest is drift."""
    return df.where(~F.coalesce(F.sha2(text, 256) == F.lower(expected), F.lit(False))).select(key)


def cluster_gate(df: DataFrame, cluster: str, n_clusters: int | None = None, most: int | None = None) -> None:
    """Every row has a cluster; clusters are as many as declared and no larger."""
    missing = df.where(is_blank(F.col(cluster))).limit(1).count()
    if missing:
        _stop("cluster", f"{cluster} has blank values")
    k, top = df.groupBy(cluster).count().agg(F.count("*"), F.max("count")).first()
    if n_clusters is not None and k != n_clusters:
        _stop("cluster", f"{k} clusters, {n_clusters} declared")
    if most is not None and (top or 0) > most:
        _stop("cluster", f"a cluster has {top} rows, {most} allowed")


def cells_gate(df: DataFrame, by: Sequence[str], expected: DataFrame, tolerance: float = 0.05) -> None:
    """Cell counts are within a relative tolerance of the expected `n`; a difference of just that much passes."""
    got = df.groupBy(*by).agg(F.count("*").alias("_got"))
    both = expected.select(*by, F.col("n").alias("_want")).join(got, list(by), "full")
    gap = F.abs(F.coalesce("_got", F.lit(0)) - F.coalesce("_want", F.lit(0))) / F.greatest(F.coalesce("_want", F.lit(0)), F.lit(1))
    bad = both.where(gap > tolerance + 1e-12).count()
    if bad:
        _stop("cells", f"{bad} cells are off by more than {tolerance:.0%}")


def geoid_gate(df: DataFrame, reference: DataFrame, key: str, width: int = 11, least: float = 0.90) -> None:
    """Codes have the width and most are in the reference."""
    odd = df.where(F.col(key).isNotNull() & ~F.col(key).rlike(rf"^\d{{{width}}}$")).limit(1).count()
    if odd:
        _stop("geoid", f"{key} has codes that are not {width} digits")
    share = containment(df, reference, key).first().containment or 0.0
    if share < least:
        _stop("geoid", f"{share:.1%} of codes are known, {least:.0%} needed")


def power_table_gate(df: DataFrame) -> None:
    """Power grid rows add up: two physicians a pair, two calls a physician, power finite and in 0 to 1, some usable fits."""
    bad = (F.col("Physicians") != 2 * F.col("Pairs")) | (F.col("Total_Calls") != 2 * F.col("Physicians")) | ~F.col("Power").between(0, 1) | F.isnan("Power") | (F.col("Usable_Fits") <= 0)
    n = df.where(F.coalesce(bad, F.lit(True))).count()
    if n:
        _stop("power", f"{n} rows don't add up")


def sources_gate(manifest: DataFrame, placeholders: Sequence[str] = ("TODO", "TBD", "UNKNOWN", "?")) -> None:
    bad = manifest.where(is_blank(F.col("source"), trim=True) | F.upper(F.btrim("source")).isin(*placeholders)).count()
    if bad:
        _stop("sources", f"{bad} columns have no source")


def business_days_gate(df: DataFrame, start: str, end: str, computed: str) -> None:
    """A computed column equals the calendar's count, nulls included."""
    from plinth.functions.dates import add_business_days

    checked = add_business_days(df, start, end, "_want")
    n = checked.where(~F.col(computed).cast("int").eqNullSafe(F.col("_want"))).count()
    if n:
        _stop("business days", f"{n} rows disagree with the calendar")


def waits_gate(df: DataFrame, wait: str, contacted: Column) -> None:
    """No wait without a contact."""
    n = df.where(F.col(wait).isNotNull() & ~F.coalesce(contacted, F.lit(False))).count()
    if n:
        _stop("waits", f"{n} rows have a wait without a contact")


def preflight(gates: Sequence[tuple[str, Callable[[], object]]]) -> list[str]:
    """Gates in order; the first that fails stops the run."""
    passed = []
    for name, gate in gates:
        gate()
        passed.append(name)
    return passed


def report(spark, gates: Sequence[tuple[str, Callable[[], object]]]) -> DataFrame:
    """gate, passed and why of every gate, whether or not one before it fails; other errors than broken contracts are raised."""
    rows = []
    for name, gate in gates:
        try:
            gate()
            rows.append((name, True, None))
        except ContractError as e:
            rows.append((name, False, str(e)))
    return spark.createDataFrame(rows, "gate string, passed boolean, why string")


# row rules -------------------------------------------------------------------


def _finding(df: DataFrame, rule: str, detail: str, n: Column) -> DataFrame:
    return df.agg(n.cast("long").alias("n")).where("n > 0").select(F.lit(rule).alias("rule"), F.lit(detail).alias("detail"), "n")


def rule_row_count(df: DataFrame, n: int) -> DataFrame:
    return _finding(df, "row_count", f"{n} rows needed", F.abs(F.count("*") - n))


def rule_unique(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Repeats of non-null values, column by column, by pre-aggregated groups."""
    return [_finding(df.where(F.col(c).isNotNull()).groupBy(c).count(), "unique", c, F.coalesce(F.sum(F.col("count") - 1), F.lit(0))) for c in columns]


def rule_non_empty(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Null or white space only; the literal NA is a value here."""
    return [_finding(df, "non_empty", c, F.count_if(is_blank(F.col(c), (), trim=True))) for c in columns]


def rule_domain(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> list[DataFrame]:
    return [_finding(df, "domain", c, F.count_if(~F.col(c).isin(*v))) for c, v in domains.items()]


def rule_group_size(df: DataFrame, group: str, size: int) -> DataFrame:
    return _finding(df.groupBy(group).count().where(F.col("count") != size), "group_size", f"{group} x {size}", F.count("*"))


def rule_one_per_arm(df: DataFrame, group: str, arm: str, arms: Sequence[str]) -> DataFrame:
    counts = df.groupBy(group).agg(*[F.count_if(F.col(arm) == a).alias(f"a{i}") for i, a in enumerate(arms)])
    bad = F.lit(False)
    for i in range(len(arms)):
        bad = bad | (F.col(f"a{i}") != 1)
    return _finding(counts.where(bad), "one_per_arm", f"{group} x {arm}", F.count("*"))


def rule_id_coverage(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The columns together hold each of 1..n once: ids that are missing, repeated or beyond."""
    ids = df.select(F.explode(F.array(*[F.col(c).cast("long") for c in columns])).alias("id")).groupBy("id").count()
    want = df.sparkSession.range(1, n + 1)
    odd = ids.join(want.withColumn("_in", F.lit(1)), "id", "full").where("count is null or count <> 1 or _in is null")
    return _finding(odd, "id_coverage", f"1..{n}", F.count("*"))


def rule_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    return _finding(df, "differ", f"{a} <> {b}", F.count_if(F.col(a).eqNullSafe(F.col(b))))


def rule_known_forms(df: DataFrame, forms: DataFrame, form: str) -> DataFrame:
    """`<form>_complete` columns name forms that the dictionary has; only column names and form names are gathered."""
    named = df.sparkSession.createDataFrame([(c.removesuffix("_complete"),) for c in df.columns if c.endswith("_complete")], "form string")
    return _finding(named.join(forms.select(F.col(form).alias("form")), "form", "left_anti"), "known_forms", "unknown form", F.count("*"))


def rule_same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    from plinth.operators.joins import key_agreement

    return _finding(key_agreement(a, b, [key]), "same_keys", key, F.count("*"))


def all_findings(spark, rules: Sequence[tuple[str, Callable[[], DataFrame | list[DataFrame]]]]) -> DataFrame:
    """Findings of all rules in one table; a rule that can't run is a finding."""
    out = spark.createDataFrame([], FINDING)
    for name, rule in rules:
        try:
            made = rule()
            for df in made if isinstance(made, list) else [made]:
                out = out.unionByName(df)
        except Exception as e:
            out = out.unionByName(spark.createDataFrame([("cannot_run", f"{name}: {type(e).__name__}: {str(e).splitlines()[0][:200]}", 1)], FINDING))
    return out
