"""Queries of statistics, contracts, drift and streaming-shaped windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import aggs, drift, gates, joins, reshape, stats
from plinth.operators.lineage import scratch_path
from plinth.plans import fit_sql
from plinth.plans.registry import query
from plinth.sources.io import read_table as t
from plinth.streaming import events as ev

Spark = SparkSession


def newton_sql(rows: str, y: str, xs: list[str], family: str, rounds: int = 25) -> str:
    """CTEs of a binomial or Poisson model by Newton's method: `fit` has one row, b0..b2 and the inverse information v00..v22.

    `rows` is a table with the outcome `y` and at most two covariates; missing ones are padded by a zero column.
    """
    x = ["1", *xs, *["0"] * (2 - len(xs))]
    eta = "b0" + "".join(f" + b{j} * {x[j]}" for j in (1, 2))
    mu = f"1 / (1 + exp(-({eta})))" if family == "binomial" else f"exp({eta})"
    w = "m * (1 - m)" if family == "binomial" else "m"
    start = "0" if family == "binomial" else f"ln(avg({y}))"
    pad = 1 if len(xs) == 1 else 0  # keeps the information regular where the third column is padding
    info = ", ".join(f"sum(w * {x[i]} * {x[j]}){f' + {pad}' if i == j == 2 else ''} AS h{i}{j}" for i in range(3) for j in range(i, 3))
    score = ", ".join(f"sum(({y} - m) * {x[i]}) AS g{i}" for i in range(3))
    minor = {"00": "h11 * h22 - h12 * h12", "01": "h02 * h12 - h01 * h22", "02": "h01 * h12 - h02 * h11", "11": "h00 * h22 - h02 * h02", "12": "h01 * h02 - h00 * h12", "22": "h00 * h11 - h01 * h01"}
    det = f"(h00 * ({minor['00']}) + h01 * ({minor['01']}) + h02 * ({minor['02']}))"
    at = lambda i, j: minor[f"{min(i, j)}{max(i, j)}"]
    step = ", ".join(f"b{i} + ({' + '.join(f'({at(i, j)}) * g{j}' for j in range(3))}) / {det} AS b{i}" for i in range(3))
    inverse = ", ".join(f"({minor[k]}) / {det} AS v{k}" for k in minor)
    sums = lambda source: f"SELECT k, b0, b1, b2, {info}, {score} FROM (SELECT *, {w} AS w FROM (SELECT *, {mu} AS m FROM {source}, {rows})) GROUP BY ALL"
    return f"it AS (SELECT 0 AS k, CAST({start} AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM {rows} UNION ALL SELECT k + 1, {step} FROM ({sums('it')}) WHERE k < {rounds}), fit AS (SELECT b0, b1, b2, {inverse} FROM ({sums(f'(SELECT * FROM it WHERE k = {rounds}) z')}))"


def effects_sql(names: list[str]) -> str:
    """Rows of an effects table, exponentiated, from `fit`."""
    q = 1.959963984540054
    return " UNION ALL ".join(f"SELECT '{n}' AS term, round(exp(b{i}), 6) AS estimate, round(exp(b{i} - {q} * sqrt(v{i}{i})), 6) AS low, round(exp(b{i} + {q} * sqrt(v{i}{i})), 6) AS high, round(b{i} / sqrt(v{i}{i}), 4) AS z FROM fit" for i, n in enumerate(names))


def rounded(effects: DataFrame, *more: str) -> DataFrame:
    return effects.select(*more, "term", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")], F.round("z", 4).alias("z"))


_ORDERS = "rows AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y, o_totalprice / 1e5 AS price, CAST(month(o_orderdate) AS DOUBLE) AS month FROM orders)"


@query("""WITH k AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS a, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS c, count(*) FILTER (l_returnflag <> 'R') AS n2 FROM lineitem),
g AS (SELECT *, abs(a / n1 - c / n2) AS gap, (a + c) / (n1 + n2) AS p FROM k), h AS (SELECT *, least(0.5, gap / (1 / n1 + 1 / n2)) AS y FROM g)
SELECT round(a / n1, 6) AS p1, round(c / n2, 6) AS p2, round(pow((gap - y * (1 / n1 + 1 / n2)) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 2), 6) AS chi2 FROM h""")
def st_07_two_proportions(spark: Spark, d: str) -> DataFrame:
    r = stats.two_proportions(t(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return r.select(*[F.round(c, 6).alias(c) for c in ("p1", "p2", "chi2")])


@query("""WITH k AS (SELECT count(*) FILTER (c_mktsegment = 'MACHINERY' AND c_acctbal < 0) AS a, count(*) FILTER (c_mktsegment = 'MACHINERY' AND c_acctbal >= 0) AS b, count(*) FILTER (c_mktsegment <> 'MACHINERY' AND c_acctbal < 0) AS c, count(*) FILTER (c_mktsegment <> 'MACHINERY' AND c_acctbal >= 0) AS d FROM customer),
x AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM k),
p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p FROM x)
SELECT round(sum(p) FILTER (p <= (SELECT p FROM p WHERE x = a) * (1 + 1e-7)), 6) AS p_value FROM p""")
def st_08_fisher_exact(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    p = stats.fisher_exact(*stats.table_2x2(c, F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") < 0))
    return spark.createDataFrame([(round(p, 6),)], "p_value double")


@query("""WITH p AS (SELECT o_orderkey // 2 AS pair, max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice > 200000 END) AS x, max(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice > 200000 END) AS y FROM orders GROUP BY 1)
SELECT count(*) AS n_pairs, count(*) FILTER (x AND NOT y) AS only_first, count(*) FILTER (NOT x AND y) AS only_second, round((count(*) FILTER (x AND NOT y) - count(*) FILTER (NOT x AND y)) / count(*), 6) AS risk_difference,
(WITH k AS (SELECT count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM p WHERE x IS NOT NULL AND y IS NOT NULL) SELECT round(least(1, CASE WHEN b = c THEN 1 ELSE 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))) END), 8) FROM k, range(0, CAST(least(b, c) AS BIGINT) + 1) r(i) GROUP BY b, c) AS p_value
FROM p WHERE x IS NOT NULL AND y IS NOT NULL""")
def st_09_mcnemar(spark: Spark, d: str) -> DataFrame:
    high = F.col("o_totalprice") > 200000
    p = t(spark, d, "orders").groupBy(F.expr("o_orderkey div 2").alias("pair")).agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, high)).alias("x"), F.max(F.when(F.col("o_orderkey") % 2 == 1, high)).alias("y"))
    return stats.mcnemar(p, "pair", "x", "y").select("n_pairs", "only_first", "only_second", F.round("risk_difference", 6).alias("risk_difference"), F.round("p_value", 8).alias("p_value"))


@query(f"""WITH r AS (SELECT l_returnflag = 'R' AS arm, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS k FROM lineitem),
t AS (SELECT sum(pow(n, 3) - n) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_quantity)), u AS (SELECT CAST(count(*) FILTER (arm) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT arm) AS DOUBLE) AS n2, sum(k) FILTER (arm) - count(*) FILTER (arm) * (count(*) FILTER (arm) + 1) / 2 AS u FROM r),
z AS (SELECT *, u - n1 * n2 / 2 AS off, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM u, t)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 1) AS u, round((off - 0.5 * sign(off)) / sd, 6) AS z, round({fit_sql.normal_tail('(off - 0.5 * sign(off)) / sd')}, 5) AS p_value FROM z""")
def st_10_rank_sum(spark: Spark, d: str) -> DataFrame:
    return stats.rank_sum(t(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select("n1", "n2", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"), F.round("p_value", 5).alias("p_value"))


@query("""WITH v AS (SELECT l_discount * 10 AS x, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total FROM v),
k AS (SELECT max(greatest(abs(upto / total - least(greatest(x, 0), 1)), abs(least(greatest(x, 0), 1) - (upto - n) / total))) AS d, CAST(max(total) AS BIGINT) AS n FROM s), w AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS t FROM k)
SELECT round(d, 6) AS d, n, round(least(1, greatest(0, 2 * sum(pow(-1, i - 1) * exp(-2 * i * i * t * t)))), 8) AS p_value FROM w, range(1, 101) r(i) GROUP BY d, n""")
def st_11_ks_uniform(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("x"))
    found = stats.ks_distance(li, "x", stats.uniform_cdf).first()
    return spark.createDataFrame([(round(found.d, 6), found.n, round(stats.ks_p(found.d, found.n), 8))], "d double, n long, p_value double")


@query("""WITH x AS (SELECT l_returnflag, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, CAST(g AS INTEGER) AS day, count(*) AS n, round(count(*) FILTER (days BETWEEN 0 AND g) / count(*), 8) AS access FROM x, range(0, 61) r(g) GROUP BY ALL""")
def st_15_access_curve(spark: Spark, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", F.date_diff("l_shipdate", "o_orderdate").alias("days"))
    return stats.access_curve(rows, ["l_returnflag"], "days", F.lit(True), 60).withColumn("access", F.round("access", 8))


@query("""SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem""")
def st_06_ols(spark: Spark, d: str) -> DataFrame:
    fit = stats.fit_glm(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "gaussian")
    return spark.createDataFrame([(round(fit["coefficients"][0], 3), round(fit["coefficients"][1], 4))], "intercept double, slope double")


@query("""SELECT round(ln((count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F')) / (count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O'))) - ln((count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F')) / (count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O'))), 5) AS log_odds_ratio FROM lineitem""")
def st_01_02_logistic(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("x"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    fit = stats.fit_glm(li, "y", ["x"], "binomial")
    stats.convergence_gate(fit)
    return spark.createDataFrame([(round(fit["coefficients"][1], 5),)], "log_odds_ratio double")


@query("SELECT round(ln(avg(l_quantity) FILTER (l_returnflag = 'R') / avg(l_quantity) FILTER (l_returnflag <> 'R')), 6) AS log_rate_ratio FROM lineitem")
def st_16_poisson(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("x"), F.col("l_quantity").alias("y"))
    return spark.createDataFrame([(round(stats.fit_glm(li, "y", ["x"], "poisson")["coefficients"][1], 6),)], "log_rate_ratio double")


@query(f"WITH RECURSIVE {_ORDERS}, {newton_sql('rows', 'y', ['price', 'month'], 'binomial')} SELECT o_orderkey, round(1 / (1 + exp(-(b0 + b1 * price + b2 * month))), 6) AS propensity FROM rows, fit")
def st_01_propensity(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").cast("int").alias("treated"), (F.col("o_totalprice") / 1e5).alias("price"), F.month("o_orderdate").alias("month"))
    return stats.predict(o, stats.fit_glm(o, "treated", ["price", "month"]), "propensity").select("o_orderkey", F.round("propensity", 6).alias("propensity"))


#: Maximum likelihood for a two-level factor: means by level, and theta by ternary search on its logarithm.
_NB_SEARCH = """lvl AS (SELECT l_returnflag = 'R' AS r, avg(l_quantity) AS m FROM lineitem GROUP BY 1), y AS (SELECT l_quantity AS y, avg(m) AS m, count(*) AS n FROM lineitem JOIN lvl ON (l_returnflag = 'R') = r GROUP BY l_quantity, r),
it AS (SELECT 0 AS k, CAST(-5 AS DOUBLE) AS a, CAST(8 AS DOUBLE) AS b UNION ALL
  SELECT k + 1, CASE WHEN sum(n * ll1) < sum(n * ll2) THEN a + (b - a) / 3 ELSE a END, CASE WHEN sum(n * ll1) < sum(n * ll2) THEN b ELSE b - (b - a) / 3 END
  FROM (SELECT k, a, b, n, lgamma(y + t1) - lgamma(t1) + t1 * ln(t1 / (t1 + m)) + y * ln(m / (t1 + m)) AS ll1, lgamma(y + t2) - lgamma(t2) + t2 * ln(t2 / (t2 + m)) + y * ln(m / (t2 + m)) AS ll2
    FROM (SELECT *, exp(a + (b - a) / 3) AS t1, exp(b - (b - a) / 3) AS t2 FROM it, y WHERE k < 45)) GROUP BY k, a, b),
th AS (SELECT exp((a + b) / 2) AS t FROM it WHERE k = 45)"""


def _quantities(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("x"), F.col("l_quantity").alias("y"))


@query(f"WITH RECURSIVE {_NB_SEARCH} SELECT round(ln(max(m) FILTER (NOT r)), 6) AS intercept, round(ln(max(m) FILTER (r) / max(m) FILTER (NOT r)), 6) AS log_rate_ratio, round((SELECT t FROM th), 3) AS theta FROM lvl")
def st_03_negative_binomial(spark: Spark, d: str) -> DataFrame:
    fit = stats.fit_negative_binomial(_quantities(spark, d), "y", ["x"])
    stats.convergence_gate(fit)
    return spark.createDataFrame([(*[round(b, 6) for b in fit["coefficients"]], round(fit["theta"], 3))], "intercept double, log_rate_ratio double, theta double")


_LL = "sum(lgamma(y + t) - lgamma(t) - lgamma(y + 1) + t * ln(t / (t + m)) + y * ln(m / (t + m)))"


@query(f"WITH RECURSIVE {_NB_SEARCH}, a AS (SELECT l_quantity AS y, m, t, (SELECT avg(l_quantity) FROM lineitem) AS g FROM lineitem JOIN lvl ON (l_returnflag = 'R') = r, th) SELECT round(2 * ({_LL} - {_LL.replace('m)', 'g)').replace('(m /', '(g /')}), 2) AS chi2, 1 AS df, round({fit_sql.normal_tail(f"sqrt(greatest(0, 2 * ({_LL} - {_LL.replace('m)', 'g)').replace('(m /', '(g /')})))")}, 5) AS p_value FROM a")
def st_03_20_likelihood_ratio(spark: Spark, d: str) -> DataFrame:
    q = _quantities(spark, d)
    large = stats.fit_negative_binomial(q, "y", ["x"])
    small = {**stats.fit_glm(q, "y", [], "negative_binomial", large["theta"]), "theta": large["theta"]}
    return stats.nested_test(q, small, large, "y").select(F.round("chi2", 2).alias("chi2"), "df", F.round("p_value", 5).alias("p_value"))


@query(f"""WITH RECURSIVE {_NB_SEARCH}, a AS (SELECT l_quantity AS y, m, t FROM lineitem JOIN lvl ON (l_returnflag = 'R') = r, th),
f AS (SELECT 'poisson' AS family, sum(y * ln(m) - m - lgamma(y + 1)) AS ll, sum(pow(y - m, 2) / m) / (count(*) - 2) AS phi, avg(exp(-m)) AS e, 2 AS k FROM a UNION ALL SELECT 'negative_binomial', {_LL}, sum(pow(y - m, 2) / (m + m * m / t)) / (count(*) - 2), avg(pow(t / (t + m), t)), 3 FROM a)
SELECT family, round(ll, 1) AS log_likelihood, round(2 * k - 2 * ll, 1) AS aic, round(phi, 4) AS dispersion, round(e, 6) AS expected_zeros, CAST(0 AS DOUBLE) AS observed_zeros FROM f""")
def st_20_22_count_families(spark: Spark, d: str) -> DataFrame:
    c = stats.compare_families(_quantities(spark, d), "y", ["x"])
    return c.select("family", F.round("log_likelihood", 1).alias("log_likelihood"), F.round("aic", 1).alias("aic"), F.round("dispersion", 4).alias("dispersion"), F.round("expected_zeros", 6).alias("expected_zeros"), "observed_zeros")


_LINE_KNOTS = "k AS (SELECT quantile_disc(l_quantity, 0.1) AS k1, quantile_disc(l_quantity, 0.5) AS k2, quantile_disc(l_quantity, 0.9) AS k3 FROM lineitem)"
_BEND = " - ".join(f"(pow(greatest(x - {k}, 0), 3) - pow(greatest(x - k3, 0), 3)) / ((k3 - {k}) * (k3 - k1))" for k in ("k1", "k2"))


@query(f"""WITH RECURSIVE {_LINE_KNOTS}, l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem), rows AS (SELECT y, x, {_BEND} AS bent FROM l, k),
{newton_sql('rows', 'y', ['x', 'bent'], 'binomial')} SELECT x AS quantity, round(1 / (1 + exp(-(b0 + b1 * x + b2 * bent))), 6) AS share FROM (SELECT DISTINCT x, bent FROM rows), fit""")
def st_22_spline(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").cast("double").alias("quantity"))
    rows, fit = stats.fit_spline(li, "y", "quantity")
    return stats.predict(rows.drop("y").distinct(), fit, "share").select("quantity", F.round("share", 6).alias("share"))


@query("""WITH RECURSIVE c AS (SELECT count(l_orderkey) FILTER (o_orderpriority = '1-URGENT') AS y FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
s AS (SELECT count(*) AS n, count(*) FILTER (y > 0) AS pos, avg(y) FILTER (y > 0) AS m, avg(y) AS a, sum(y) AS total, sum(lgamma(y + 1)) AS lg FROM c),
it AS (SELECT 0 AS k, m AS mu FROM s UNION ALL SELECT k + 1, m * (1 - exp(-mu)) FROM it, s WHERE k < 400),
f AS (SELECT mu, 1 - pos / n / (1 - exp(-mu)) AS extra, s.* FROM it, s WHERE k = 400)
SELECT round(mu, 4) AS mean_count, round(extra, 4) AS extra_zeros, round(2 * ((n - pos) * ln(extra + (1 - extra) * exp(-mu)) + pos * ln(1 - extra) + total * ln(mu) - pos * mu - total * ln(a) + n * a), 2) AS chi2 FROM f""")
def st_20_zero_inflated(spark: Spark, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    urgent = t(spark, d, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("l_orderkey"))
    counts = urgent.join(lines, "l_orderkey", "left").select(F.coalesce("n", F.lit(0)).alias("y"))
    fit = stats.fit_zero_inflated(counts, "y")
    row = (round(math.exp(fit["coefficients"][0]), 4), round(fit["extra_zeros"], 4), round(2 * (fit["log_likelihood"] - fit["poisson_log_likelihood"]), 2))
    return spark.createDataFrame([row], "mean_count double, extra_zeros double, chi2 double")


@query(f"WITH RECURSIVE {_ORDERS}, {newton_sql('rows', 'y', ['price'], 'binomial')} {effects_sql(['(intercept)', 'price'])}")
def st_13_effects(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select((F.col("o_orderstatus") == "O").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"))
    return rounded(stats.effects(o, stats.fit_glm(o, "y", ["price"])))


@query(f"WITH RECURSIVE rows AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS arm, l_discount, l_quantity FROM lineitem), {newton_sql('rows', 'l_quantity', ['arm', 'l_discount'], 'poisson')} SELECT arm, round(exp(b0 + b1 * arm + b2 * (SELECT avg(l_discount) FROM rows)), 6) AS cell_mean FROM (SELECT DISTINCT arm FROM rows), fit")
def st_12_cell_means(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("arm"), "l_discount", "l_quantity")
    return stats.cell_means(li, stats.fit_glm(li, "l_quantity", ["arm", "l_discount"], "poisson"), ["arm"]).withColumn("cell_mean", F.round("cell_mean", 6))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m, coalesce(var_pop(o_totalprice) * count(*), 0) AS ss FROM orders GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(ss) / (sum(n) - count(*)) AS msw, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) AS msb, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM g),
b AS (SELECT *, greatest((msb - msw) / n0, 0) AS vb FROM t)
SELECT CAST(k AS BIGINT) AS n_groups, round(vb / 1e6, 4) AS var_between, round(msw / 1e6, 4) AS var_within, round(vb / (vb + msw), 8) AS icc FROM b""")
def st_14_variance_components(spark: Spark, d: str) -> DataFrame:
    v = stats.variance_components(t(spark, d, "orders"), "o_custkey", "o_totalprice")
    return v.select("n_groups", F.round(F.col("var_between") / 1e6, 4).alias("var_between"), F.round(F.col("var_within") / 1e6, 4).alias("var_within"), F.round("icc", 8).alias("icc"))


@query("SELECT caliper, count(*) FILTER (g <= caliper) AS n_pairs, round(avg(g) FILTER (g <= caliper), 4) AS mean_gap FROM (SELECT abs(s_acctbal - c_acctbal) AS g FROM supplier JOIN customer ON s_nationkey = c_nationkey), (VALUES (CAST(500 AS DOUBLE)), (100), (50)) v(caliper) GROUP BY 1")
def st_23_calipers(spark: Spark, d: str) -> DataFrame:
    p = t(spark, d, "supplier").join(t(spark, d, "customer"), F.col("s_nationkey") == F.col("c_nationkey")).select(F.abs(F.col("s_acctbal") - F.col("c_acctbal")).alias("g"))
    return stats.caliper_sensitivity(p, "g", [500, 100, 50], mean_gap=F.col("g")).withColumn("mean_gap", F.round("mean_gap", 4))


def _named(sql: str, name: str) -> str:
    """CTEs of `newton_sql` under names of their own."""
    return sql.replace("it AS (", f"it_{name} AS (").replace("FROM it", f"FROM it_{name}").replace("fit AS (", f"fit_{name} AS (")


#: name, rows, covariates of each pre-specified sensitivity analysis.
_VARIANTS = [
    ("all", "1 = 1", ["price"]),
    ("first_half", "month <= 6", ["price"]),
    ("second_half", "month > 6", ["price"]),
    ("adjusted", "1 = 1", ["price", "month"]),
    ("cheap", "price < 2", ["price"]),
    ("one_per_customer", "is_first", ["price"]),
    ("dear_adjusted", "price > 1", ["price", "month"]),
]
_FIRSTS = "rows AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y, o_totalprice / 1e5 AS price, CAST(month(o_orderdate) AS DOUBLE) AS month, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_first FROM orders)"


@query("WITH RECURSIVE " + _FIRSTS + ", " + ", ".join(_named(newton_sql(f"(SELECT * FROM rows WHERE {keep}) q", "y", xs, "binomial"), name) for name, keep, xs in _VARIANTS)
    + " " + " UNION ALL ".join(f"SELECT '{name}' AS variant, * FROM ({effects_sql(['(intercept)', *xs]).replace('FROM fit', f'FROM fit_{name}')})" for name, _, xs in _VARIANTS))
def st_24_sensitivities(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "O").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"), F.month("o_orderdate").alias("month"))
    firsts = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("_first"))
    o = o.join(firsts, "o_custkey").withColumn("is_first", F.col("o_orderkey") == F.col("_first"))
    return rounded(stats.sensitivities(o, [(name, F.expr(keep), xs) for name, keep, xs in _VARIANTS], "y"), "variant")


def _orders(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "O").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"))


_DATED = "rows AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y, o_totalprice / 1e5 AS price, o_orderdate, CAST('0x' || substr(md5('2|' || o_custkey), 1, 8) AS BIGINT) % 3 AS fold FROM orders)"


@query(f"WITH RECURSIVE {_DATED}, old AS (SELECT * FROM rows WHERE year(o_orderdate) < 1996), {_named(newton_sql('old', 'y', ['price'], 'binomial'), 'old')}, late AS (SELECT y, b0 + b1 * price AS eta FROM rows, fit_old WHERE year(o_orderdate) >= 1996), {newton_sql('(SELECT y, eta FROM late) l', 'y', ['eta'], 'binomial')} SELECT round(b0, 3) AS intercept, round(b1, 3) AS slope, (SELECT count(*) FROM late) AS n FROM fit")
def st_21_temporal_recalibration(spark: Spark, d: str) -> DataFrame:
    o = _orders(spark, d)
    fit = stats.fit_glm(o.where(F.year("o_orderdate") < 1996), "y", ["price"])
    got = stats.recalibration(o.where(F.year("o_orderdate") >= 1996), fit, "y")
    return got.select(F.round("intercept", 3).alias("intercept"), F.round("slope", 3).alias("slope"), "n")


@query(f"WITH RECURSIVE {_DATED}, " + ", ".join(_named(newton_sql(f"(SELECT * FROM rows WHERE fold <> {f}) q", "y", ["price"], "binomial"), f"f{f}") for f in range(3))
    + " " + " UNION ALL ".join(f"SELECT {f} AS fold, count(*) AS n, round(avg(pow(1 / (1 + exp(-(b0 + b1 * price))) - y, 2)), 8) AS brier FROM rows, fit_f{f} WHERE fold = {f}" for f in range(3)))
def st_21_clustered_folds(spark: Spark, d: str) -> DataFrame:
    return stats.cross_validated(_orders(spark, d), "y", ["price"], "o_custkey", 3, 2).withColumn("brier", F.round("brier", 8))


_POISSON = [sum(2.718281828459045**-1 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[: n + 1]) for n in range(8)]
_DRAWN = " + ".join(f"(u > {c!r})::INT" for c in _POISSON)


@query(f"WITH RECURSIVE {_DATED}, " + ", ".join(
    f"drawn{k} AS (SELECT y, price FROM (SELECT y, price, unnest(range(0, w)) FROM (SELECT y, price, {_DRAWN} AS w FROM (SELECT y, price, (CAST('0x' || substr(md5('{k}|' || o_custkey), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM rows)))), {_named(newton_sql(f'drawn{k}', 'y', ['price'], 'binomial'), f'b{k}')}" for k in range(3)
) + " " + " UNION ALL ".join(f"SELECT {k} AS draw, '(intercept)' AS term, round(b0, 5) AS estimate FROM fit_b{k} UNION ALL SELECT {k}, 'price', round(b1, 5) FROM fit_b{k}" for k in range(3)))
def st_21_bootstrap(spark: Spark, d: str) -> DataFrame:
    return stats.bootstrap(_orders(spark, d), "y", ["price"], ["o_custkey"], 3).withColumn("estimate", F.round("estimate", 5))


@query("SELECT CAST(CAST('0x' || substr(md5('1|' || o_custkey), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n, count(DISTINCT o_custkey) AS n_clusters FROM orders GROUP BY 1")
def st_21_folds(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy(stats.folds("o_custkey", 5, 1).alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_clusters"))


# contracts -----------------------------------------------------------------------


@query("""SELECT 'unique' AS rule, 'o_custkey' AS detail, CAST(count(o_custkey) - count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders HAVING count(o_custkey) > count(DISTINCT o_custkey)
UNION ALL SELECT 'domain', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders UNION ALL SELECT 'row_count', '10 rows needed', count(*) - 10 FROM orders
UNION ALL SELECT 'group_size', 'o_custkey x 4', count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) <> 4)""")
def row_11_findings(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return gates.all_findings(spark, [("row_count", lambda: gates.rule_row_count(o, 10)), ("unique", lambda: gates.rule_unique(o, ["o_custkey", "o_orderkey"])), ("non_empty", lambda: gates.rule_non_empty(o, ["o_orderstatus"])), ("domain", lambda: gates.rule_domain(o, {"o_orderstatus": ["O", "F"]})), ("group_size", lambda: gates.rule_group_size(o, "o_custkey", 4))])


@query("SELECT 'one_per_arm' AS rule, 'pair x arm' AS detail, count(*) AS n FROM (SELECT o_orderkey // 3 AS pair FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 2 = 0) <> 1 OR count(*) FILTER (o_orderkey % 2 = 1) <> 1)")
def row_06_one_per_arm(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.expr("o_orderkey div 3").alias("pair"), F.when(F.col("o_orderkey") % 2 == 0, "PE").otherwise("Non-PE").alias("arm"))
    return gates.rule_one_per_arm(o, "pair", "arm", ["PE", "Non-PE"])


@query("WITH i AS (SELECT unnest([s_suppkey, s_suppkey + 50]) AS id FROM supplier), c AS (SELECT id, count(*) AS n FROM i GROUP BY 1) SELECT 'id_coverage' AS rule, '1..160' AS detail, count(*) AS n FROM c FULL JOIN range(1, 161) r(g) ON id = g WHERE n IS NULL OR n <> 1 OR g IS NULL")
def row_07_id_coverage(spark: Spark, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 50).alias("b"))
    return gates.rule_id_coverage(s, ["a", "b"], 160)


@query("SELECT 'same_keys' AS rule, 'k' AS detail, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n WHERE (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) > 0")
def row_10_same_keys(spark: Spark, d: str) -> DataFrame:
    return gates.rule_same_keys(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS n_owners, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def drf_05_overlapping_names(spark: Spark, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.col("p_brand").alias("package"), F.col("p_name").alias("name"))
    return drift.overlapping_names(p)


@query("SELECT coalesce(a.k, b.k) AS package, CASE WHEN a.k IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'unused' ELSE 'version' END AS finding FROM (SELECT s_suppkey * 2 AS k, s_nationkey AS v FROM supplier) a FULL JOIN (SELECT c_custkey AS k, c_nationkey AS v FROM customer) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def drf_02_lock_drift(spark: Spark, d: str) -> DataFrame:
    a = t(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("package"), F.col("s_nationkey").alias("version"))
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("package"), F.col("c_nationkey").alias("version"))
    return drift.lock_drift(a, b)


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) SELECT doc_id, count(*) AS n_hits FROM w WHERE w IN ('idiot', 'clown') GROUP BY 1""")
def str_29_deidentified(spark: Spark, d: str) -> DataFrame:
    words = spark.createDataFrame([("idiot",), ("clown",)], "w string").select(F.sha2(F.concat(F.lit("salt"), "w"), 256).alias("digest"))
    return drift.deidentified(t(spark, d, "documents"), words, "doc_id", "text", "salt")


# streaming shapes ------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: Spark, d: str) -> DataFrame:
    return ev.tumbling(t(spark, d, "events"), "1 hour", ["event_type"]).withColumn("total", F.round("total", 2))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM k GROUP BY user_id, k""")
def stream_sessions(spark: Spark, d: str) -> DataFrame:
    return ev.sessions(t(spark, d, "events"), "2 hours")


def _event_stream(spark: Spark, d: str) -> DataFrame:
    """The events as a stream of several files, in order of time, some rows twice."""
    events = t(spark, d, "events")
    twice = events.unionByName(events.where("event_id % 10 = 0"))
    folder = scratch_path(spark, "events")
    # One write after the other: a stream takes files in the order in which they came.
    cuts = events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = twice.where(F.lit(True) if low is None else F.col("ts") > F.lit(low)).where(F.lit(True) if high is None else F.col("ts") <= F.lit(high))
        part.repartition(1).write.mode("append").parquet(folder)
    schema = ", ".join(f"{n} {k}" for n, k in events.dtypes)
    return ev.read_events(spark, folder, schema, files_each=2)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark: Spark, d: str) -> DataFrame:
    rows = ev.deduplicated(_event_stream(spark, d), late="400 days").select("event_id", "user_id", "event_type")
    return ev.collected(rows, scratch_path(spark, "stream"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows_of_a_stream(spark: Spark, d: str) -> DataFrame:
    rows = ev.tumbling(ev.deduplicated(_event_stream(spark, d), late="400 days"), "1 day", ["event_type"])
    got = ev.collected(rows, scratch_path(spark, "stream"), "update", ["window_start", "event_type"])
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, i) AS attempt, ts FROM (SELECT user_id, ts, event_id, unnest(range(0, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END)) AS i FROM events)")
def stream_attempts_by_state(spark: Spark, d: str) -> DataFrame:
    got = ev.collected(ev.second_attempts(_event_stream(spark, d)), scratch_path(spark, "stream"))
    return got.select("user_id", "attempt", F.col("ts").cast("timestamp_ntz").alias("ts"))


# flagship: matched controls and their balance ---------------------------------------


@query("""WITH e AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)),
p AS (SELECT s_suppkey, s_acctbal, c_custkey, c_acctbal, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS r FROM supplier JOIN e ON s_nationkey = c_nationkey)
SELECT s_suppkey, c_custkey, round(s_acctbal, 2) AS treated, round(c_acctbal, 2) AS control FROM p WHERE r = 1""")
def matched_controls(spark: Spark, d: str) -> DataFrame:
    refused = t(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    c = t(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").join(refused, "c_custkey", "left_anti")
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))
    best = joins.nearest(s, c.withColumnRenamed("c_nationkey", "nation"), ["nation"], "s_suppkey", "s_acctbal", "c_custkey", "c_acctbal").where("c_custkey is not null")
    return best.select("s_suppkey", "c_custkey", F.round("s_acctbal", 2).alias("treated"), F.round("c_acctbal", 2).alias("control"))


@query("""WITH e AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)),
p AS (SELECT s_acctbal, c_acctbal, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS r FROM supplier JOIN e ON s_nationkey = c_nationkey)
SELECT round(avg(s_acctbal), 4) AS mean_treated, round(avg(c_acctbal), 4) AS mean_control, round((avg(s_acctbal) - avg(c_acctbal)) / sqrt((var_samp(s_acctbal) + var_samp(c_acctbal)) / 2), 6) AS smd FROM p WHERE r = 1""")
def matched_balance(spark: Spark, d: str) -> DataFrame:
    m = matched_controls(spark, d)
    arms = reshape.arms_to_rows(m, ["s_suppkey"], {"treated": "treated", "control": "control"}, "arm", "score")
    s = aggs.smd(arms, F.col("arm") == "treated", ["score"])
    return s.select(F.round("mean_treated", 4).alias("mean_treated"), F.round("mean_control", 4).alias("mean_control"), F.round("smd", 6).alias("smd"))


@query()
def st_04_binomial_mixed(spark: Spark, d: str) -> DataFrame:
    from plinth.operators import mixed

    o = t(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "O").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"))
    return stats.effects(o, mixed.fit_mixed(o, "y", ["price"], "o_custkey", nodes=5))


@query()
def st_05_negative_binomial_mixed(spark: Spark, d: str) -> DataFrame:
    from plinth.operators import mixed

    li = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("arm"), F.col("l_quantity").cast("int").alias("y"))
    return stats.effects(li, mixed.fit_mixed(li, "y", ["arm"], "l_suppkey", "negative_binomial", nodes=5))
