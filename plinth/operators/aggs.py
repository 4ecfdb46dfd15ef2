"""Aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.ranges import sum_before
from plinth.sources.io import ContractError


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """`by` and the exact median of each group, from counts of values summed up over written ranges.

    A group's values are one row for each different one, in ranges of (group, value) that cut a group of any size; the
    middle rows are those whose counts reach over the middle places. Groups without a known value are left out; without
    `by` there is one row, null if no value is known.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    values = df.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    counts = values.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    summed = sum_before(counts, [*keys, "_v"], "_n", "_before")
    groups = summed.groupBy(*keys).agg(F.min("_before").alias("_base"), F.sum("_n").alias("_all"))
    if keys:
        placed = summed.join(groups.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_base", "_all"), [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys])
    else:
        placed = summed.crossJoin(F.broadcast(groups))  # one row
    first = F.col("_before") - F.col("_base")
    hits = [(first <= at) & (at < first + F.col("_n")) for at in (F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))]
    middle = placed.where(hits[0] | hits[1]).groupBy(*keys).agg((F.sum(F.col("_v") * sum(h.cast("int") for h in hits)) / 2).alias(name))
    return middle.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], name)


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, valid count, mean, sample sd, median, min and max."""
    rest = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(value).alias("n_valid"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )
    return _beside(rest, medians(df, by, value), by).select(*by, "n", "n_valid", "mean", "sd", "median", "lowest", "highest")


def _beside(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """`df` with the columns of one row for each group; without `by`, of the one row there is (or nulls)."""
    named = groups.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], *[c for c in groups.columns if c not in by])
    if not by:
        return df.join(F.broadcast(named), F.lit(True), "left")  # one row
    return df.join(named, [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)], "left").drop(*[f"_g{i}" for i in range(len(by))])


def sorted_distinct(c: str, sep: str = " | ") -> Column:
    """Distinct non-null values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def org_classification(df: DataFrame, key: str, size: str, facility: str, threshold: int) -> DataFrame:
    """Size range, facilities and whether sizes straddle the threshold; unknown sizes stay unknown."""
    n = F.col(size).try_cast("int")
    out = df.groupBy(key).agg(F.count("*").alias("n_source_rows"), F.min(n).alias("org_size_min"), F.max(n).alias("org_size_max"), F.count_distinct(n).alias("n_distinct_org"), sorted_distinct(facility).alias("facilities"))
    straddles = (F.col("org_size_min") <= threshold) & (threshold < F.col("org_size_max"))
    return out.withColumns({"ambiguous": straddles, "is_large": F.when(~straddles, F.col("org_size_min") > threshold)})


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the weights of known values; null if these are zero."""
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def arg_max(row: Sequence[str], by: Sequence[str]) -> Column:
    """The struct of `row` with the greatest `by`."""
    return F.max_by(F.struct(*row), F.struct(*by))


def rates(df: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Count and share of each flag; a null flag is not counted as set."""
    made = []
    for name, flag in flags.items():
        made += [F.count_if(flag).alias(f"n_{name}"), (F.count_if(flag) / F.count("*")).alias(f"rate_{name}")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *made)


def contingency(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Counts by rows and the listed values of a column; zeros where there are none."""
    return df.groupBy(*rows).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many groups there are of each size."""
    return df.groupBy(*by).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def with_group_values(df: DataFrame, by: Sequence[str], **values: Column) -> DataFrame:
    """Group aggregates beside each row, by a partial aggregate joined back."""
    stats = df.groupBy(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]).agg(*[v.alias(k) for k, v in values.items()])
    same = [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
    return df.join(stats, same).drop(*[f"_g{i}" for i in range(len(by))])


def uniform_within(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Whether all values of a group are known and equal."""
    ok = (F.count_distinct(value) == 1) & (F.count(value) == F.count("*"))
    return df.groupBy(*by).agg(ok.alias("is_uniform"))


def impute_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Nulls become the median of the group, or of all rows."""
    out = _beside(df, medians(df, by, value, "_median"), by)
    return out.withColumn(name or value, F.coalesce(F.col(value).cast("double"), F.col("_median"))).drop("_median")


def z_score(df: DataFrame, value: str, name: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """Centred on the mean and scaled by the sample sd, with nulls at the median; 0 for a constant column."""
    filled = impute_median(df, value, by, "_x")
    out = _beside(filled, filled.groupBy(*by).agg(F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_sd")), by)
    return out.withColumn(name, F.coalesce(F.try_divide(F.col("_x") - F.col("_mean"), F.col("_sd")), F.lit(0.0))).drop("_x", "_mean", "_sd")


def smd(df: DataFrame, treated: Column, covariates: Sequence[str], population: bool = False) -> DataFrame:
    """covariate, means of both arms and the standardised mean difference; 0 if both sds are 0, null if an arm is empty. One pass."""
    var = F.var_pop if population else F.var_samp
    parts = []
    for c in covariates:
        a, b = F.when(treated, F.col(c)), F.when(~treated, F.col(c))
        pooled = F.sqrt((F.coalesce(var(a), F.lit(0.0)) + F.coalesce(var(b), F.lit(0.0))) / 2)
        gap = F.avg(a) - F.avg(b)
        parts.append(F.struct(F.lit(c).alias("covariate"), F.avg(a).alias("mean_treated"), F.avg(b).alias("mean_control"), F.when((pooled > 0) | gap.isNull(), gap / pooled).otherwise(0.0).alias("smd")))
    return df.agg(F.array(*parts).alias("_rows")).select(F.inline("_rows"))


def safe_percent(numerator: Column, denominator: Column, places: int = 1) -> Column:
    return F.when(denominator > 0, F.round(100.0 * numerator / denominator, places))


def turnover(panel: DataFrame, office: Sequence[str], year: str, member: str) -> DataFrame:
    """Entries, exits, mean yearly rate and largest staff of each office.

    Each observed year is compared with the office's previous observed one;
    an office seen in one year has a rate of 0. Members are distinct ids.
    """
    seen = panel.dropna(subset=[*office, year, member]).select(*office, F.col(year).alias("_y"), F.col(member).alias("_m")).distinct()
    years = seen.groupBy(*office, "_y").agg(F.count("*").alias("_staff"))
    w = Window.partitionBy(*office).orderBy("_y")  # a row for each year of one office
    years = years.withColumns({"_prev": F.lag("_y").over(w), "_before": F.lag("_staff").over(w)})
    now = years.where("_prev is not null").select(*office, "_y", "_prev", "_staff", "_before")
    stayed = seen.join(now.select(*office, "_y", "_prev"), [*office, "_y"]).join(seen.select(*office, F.col("_y").alias("_prev"), "_m"), [*office, "_prev", "_m"]).groupBy(*office, "_y").agg(F.count("*").alias("_kept"))
    steps = now.join(stayed, [*office, "_y"], "left").withColumn("_kept", F.coalesce("_kept", F.lit(0)))
    steps = steps.withColumns({"_in": F.col("_staff") - F.col("_kept"), "_out": F.col("_before") - F.col("_kept")})
    rate = (F.col("_in") + F.col("_out")) / (F.col("_staff") + F.col("_before"))
    moves = steps.groupBy(*office).agg(F.sum("_in").alias("entries"), F.sum("_out").alias("exits"), F.round(F.avg(rate), 3).alias("turnover_rate"))
    sizes = years.groupBy(*office).agg(F.max("_staff").alias("max_staff"), F.count("*").alias("n_years"))
    out = sizes.join(moves, list(office), "left")
    return out.select(*office, "n_years", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("exits", F.lit(0)).alias("exits"), F.coalesce("turnover_rate", F.lit(0.0)).alias("turnover_rate"), "max_staff")


def agreement(values: Sequence[Column]) -> Column:
    """struct(n_known, n_agree, status): how many sources are known and agree with the first known one."""
    known = F.array_compact(F.array(*values))
    agree = F.size(F.filter(known, lambda x: x == F.get(known, F.lit(0))))
    status = F.when(F.size(known) == 0, "missing").when(F.size(known) == 1, "single").when(agree == F.size(known), "agree").when(agree > 1, "partial").otherwise("conflict")
    return F.struct(F.size(known).alias("n_known"), agree.alias("n_agree"), status.alias("status"))


def waterfall(df: DataFrame, stages: Mapping[str, Column], strict: bool = True) -> DataFrame:
    """stage, n: rows that pass all stages so far, in one pass; a stage can't hold more than the one before."""
    passed = F.lit(True)
    counts = [F.struct(F.lit(0).alias("pos"), F.lit("source").alias("stage"), F.count("*").alias("n"))]
    for i, (name, ok) in enumerate(stages.items(), 1):
        passed = passed & F.coalesce(ok, F.lit(False))
        counts.append(F.struct(F.lit(i).alias("pos"), F.lit(name).alias("stage"), F.count_if(passed).alias("n")))
    return df.agg(F.array(*counts).alias("_rows")).select(F.inline("_rows"))


def checked_funnel(counts: Sequence[tuple[str, int | None]]) -> list[tuple[str, int]]:
    """A funnel whose stages are all known and never grow; nothing is inferred by subtraction."""
    before = None
    for name, n in counts:
        if n is None:
            raise ContractError(f"stage {name} is not resolved")
        if before is not None and n > before:
            raise ContractError(f"stage {name} has {n} rows, more than {before} before it")
        before = n
    return [(a, int(b)) for a, b in counts]


def tally(df: DataFrame, status: str, metrics: Mapping[str, Column]) -> DataFrame:
    """metric, value: counts by status and further scalar aggregates."""
    by = df.groupBy(F.concat(F.lit("status:"), F.coalesce(F.col(status).cast("string"), F.lit("missing"))).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    rest = df.agg(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()]).alias("_r")).select(F.inline("_r"))
    return by.unionByName(rest)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count(key) - F.count_distinct(key)).alias("n_duplicates"))


def null_profile(df: DataFrame, columns: Sequence[str], literal: str = "N/A") -> DataFrame:
    """column, nulls, literals, empties and coverage in per cent, in one pass."""
    rows = []
    for c in columns:
        s = F.col(f"`{c}`").cast("string")
        covered = s.isNotNull() & (s != "") & (s != literal)
        rows.append(F.struct(F.lit(c).alias("column_name"), F.count_if(s.isNull()).alias("n_null"), F.count_if(s == literal).alias("n_literal"), F.count_if(s == "").alias("n_empty"), F.round(100.0 * F.try_divide(F.count_if(covered), F.count("*")), 1).alias("coverage_pct")))
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def simulation_summary(df: DataFrame, by: Sequence[str], estimate: str, low: str, high: str, p: str, truth: float, alpha: float = 0.05) -> DataFrame:
    """Usable fits, bias, interval coverage and power by cell; fits without an estimate are counted apart."""
    ok = F.col(estimate).isNotNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("n_fits"),
        F.count_if(ok).alias("n_usable"),
        F.count_if(~ok).alias("n_not_estimable"),
        (F.avg(estimate) - truth).alias("bias"),
        F.avg(F.when(ok, F.lit(truth).between(F.col(low), F.col(high)).cast("int"))).alias("coverage"),
        F.avg(F.when(ok, (F.col(p) < alpha).cast("int"))).alias("power"),
    )
