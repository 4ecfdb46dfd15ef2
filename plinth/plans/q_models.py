"""Queries of models: validation by shared scans, designs with factors, marginal means, clusters, residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import crossed, design, residuals, stats
from plinth.operators.batch import fit_one
from plinth.plans import fit_sql
from plinth.plans.registry import query
from plinth.sources.io import read_table as t

Spark = SparkSession

_POISSON = [sum(2.718281828459045**-1 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[: n + 1]) for n in range(8)]
_DRAWN = " + ".join(f"(u > {c!r})::INT" for c in _POISSON)


def _orders(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").select(
        "o_custkey", (F.col("o_orderstatus") == "O").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"),
        F.month("o_orderdate").alias("month"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
    )


_ORDERS = "SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y, o_totalprice / 1e5 AS price, month(o_orderdate) AS month, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders"
_RETAINED = fit_sql.newton("rows", ["price", "month", "urgent"], "binomial", by="draw", w="w", rounds=8)


@query(f"""WITH RECURSIVE o AS ({_ORDERS}),
rows AS (SELECT * FROM (SELECT o.*, draw, {_DRAWN} AS w FROM (SELECT o.*, draw, (CAST('0x' || substr(md5(draw || '|' || o_custkey), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM o, range(0, 50) r(draw)) o) WHERE w > 0), {_RETAINED}
SELECT term, CAST(count(*) AS INTEGER) AS n_draws, CAST(count(*) FILTER (abs(z) > 1.6448536269514722) AS INTEGER) AS n_kept, round(count(*) FILTER (abs(z) > 1.6448536269514722) / count(*), 4) AS share
FROM (SELECT unnest(['price', 'month', 'urgent']) AS term, unnest([b1 / sqrt(v1_1), b2 / sqrt(v2_2), b3 / sqrt(v3_3)]) AS z FROM fit) GROUP BY term""")
def st_21_retention(spark: Spark, d: str) -> DataFrame:
    kept = stats.retention(_orders(spark, d), "y", ["price", "month", "urgent"], ["o_custkey"], draws=50, below=0.1)
    return kept.withColumn("share", F.round("share", 4))


_LINES = "SELECT l_orderkey, year(l_shipdate) AS year, l_quantity AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS arm, l_discount * 10 AS discount, CAST('0x' || substr(md5('4|' || l_suppkey), 1, 8) AS BIGINT) % 5 AS fold FROM lineitem"


def _lines(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("arm"), (F.col("l_discount") * 10).alias("discount"))


@query(f"""WITH RECURSIVE l AS ({_LINES}), rows AS (SELECT * FROM l, range(0, 5) r(draw) WHERE fold <> draw), {fit_sql.newton('rows', ['arm', 'discount'], 'poisson', by='draw', rounds=8)},
s AS (SELECT fold, y, exp(b0 + b1 * arm + b2 * discount) AS m FROM l JOIN fit ON _by = fold)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(sqrt(avg(pow(y - m, 2))), 6) AS rmse, round(avg(abs(y - m)), 6) AS mae, round(avg(y * ln(m) - m - lgamma(y + 1)), 6) AS mean_log_likelihood FROM s GROUP BY 1""")
def st_21_clustered_counts(spark: Spark, d: str) -> DataFrame:
    got = stats.cross_validated(_lines(spark, d), "y", ["arm", "discount"], "l_suppkey", 5, 4, family="poisson")
    return got.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "mean_log_likelihood")])


@query(f"""WITH RECURSIVE l AS ({_LINES}), old AS (SELECT * FROM l WHERE year < 1996), {fit_sql.newton('old', ['arm', 'discount'], 'poisson', name='old_fit')},
late AS (SELECT y, b0 + b1 * arm + b2 * discount AS eta FROM l, old_fit WHERE year >= 1996), {fit_sql.newton('late', ['eta'], 'poisson')}
SELECT (SELECT count(*) FROM old) AS n_train, (SELECT count(*) FROM late) AS n_test, (SELECT round(sqrt(avg(pow(exp(eta) - y, 2))), 6) FROM late) AS rmse, (SELECT round(avg(abs(exp(eta) - y)), 6) FROM late) AS mae,
(SELECT round(avg(exp(eta) - y), 6) FROM late) AS bias, round(b0, 3) AS intercept, round(b1, 3) AS slope FROM fit""")
def st_21_temporal_counts(spark: Spark, d: str) -> DataFrame:
    got = stats.temporal_validation(_lines(spark, d), "y", ["arm", "discount"], F.col("year") >= 1996, "poisson")
    return got.select("n_train", "n_test", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias")], F.round("intercept", 3).alias("intercept"), F.round("slope", 3).alias("slope"))


# designs -------------------------------------------------------------------------


_DUMMIES = "SELECT l_extendedprice / 1e4 AS y, l_quantity AS q, (l_returnflag = 'N')::INT AS n, (l_returnflag = 'R')::INT AS r, (l_linestatus = 'O')::INT AS o, l_quantity * (l_linestatus = 'O')::INT AS qo, ((l_returnflag = 'N') AND l_linestatus = 'O')::INT AS no, ((l_returnflag = 'R') AND l_linestatus = 'O')::INT AS ro FROM lineitem"
_DESIGN = ["q", "n", "r", "o", "no", "ro"]


def _line_design(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", (F.col("l_extendedprice") / 1e4).alias("y"))


@query(f"""WITH RECURSIVE rows AS ({_DUMMIES}), {fit_sql.newton('rows', _DESIGN, 'gaussian', rounds=1, more=['sum(pow(_y - m, 2)) AS rss', 'count(*) AS n'])}
SELECT unnest(['(intercept)', 'l_quantity', 'l_returnflag=N', 'l_returnflag=R', 'l_linestatus=O', 'l_returnflag=N:l_linestatus=O', 'l_returnflag=R:l_linestatus=O']) AS term,
unnest([{', '.join(f'round(b{i}, 6)' for i in range(7))}]) AS estimate, unnest([{', '.join(f'round(sqrt(v{i}_{i} * rss / (n - 7)), 6)' for i in range(7))}]) AS se FROM fit""")
def st_06_factors(spark: Spark, d: str) -> DataFrame:
    rows = _line_design(spark, d)
    made = design.model_matrix(rows, ["l_quantity", "l_returnflag", "l_linestatus", ("l_returnflag", "l_linestatus")], ["l_returnflag", "l_linestatus"])
    fit = design.fit_design(rows, "y", made)
    return spark.createDataFrame([(n, round(b, 6), round(e, 6)) for n, b, e in zip(fit["names"], fit["coefficients"], fit["errors"])], "term string, estimate double, se double")


_COUNTS = "SELECT l_quantity AS y, l_discount * 10 AS x, (l_returnflag = 'R')::INT AS a, (l_linestatus = 'O')::INT AS s, ((l_returnflag = 'R') AND l_linestatus = 'O')::INT AS b FROM lineitem"


@query(f"""WITH RECURSIVE rows AS ({_COUNTS}), {fit_sql.newton('rows', ['x', 'a', 's'], 'poisson', name='small', more=['sum(_y * e - m) AS ll'])}, {fit_sql.newton('rows', ['x', 'a', 's', 'b'], 'poisson', name='large', more=['sum(_y * e - m) AS ll'])}
SELECT round(2 * (large.ll - small.ll), 4) AS chi2, 1 AS df FROM small, large""")
def st_20_interaction_test(spark: Spark, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select("l_linestatus", F.col("l_quantity").alias("y"), (F.col("l_discount") * 10).alias("x"), (F.col("l_returnflag") == "R").cast("string").alias("returned"))
    factors = ["returned", "l_linestatus"]
    full = design.model_matrix(rows, ["x", "returned", "l_linestatus", ("returned", "l_linestatus")], factors)
    fitted = full.apply(rows)
    return stats.nested_counts_test(fitted, "y", full.names, full.names[:-1]).select(F.round("chi2", 4).alias("chi2"), "df")


def _cell_sql(p: int, cells: list[tuple[str, list[str]]]) -> str:
    """Mean and limits of each cell, given its design row as SQL values."""
    parts = []
    for labels, x in cells:
        eta = " + ".join(f"b{i} * {v}" for i, v in enumerate(x))
        var = " + ".join(f"v{i}_{j} * {x[i]} * {x[j]}" for i in range(p) for j in range(p))
        parts.append(f"SELECT {labels}, round(exp({eta}), 6) AS cell_mean, round(exp({eta} - 1.959963984540054 * sqrt({var})), 6) AS low, round(exp({eta} + 1.959963984540054 * sqrt({var})), 6) AS high, round(sqrt({var}), 8) AS se FROM fit, mean")
    return " UNION ALL ".join(parts)


_FOUR = [(f"'{str(bool(a)).lower()}' AS returned, '{s}' AS l_linestatus", ["1", "mx", str(a), str(int(s == 'O')), str(int(a and s == 'O'))]) for a in (0, 1) for s in "FO"]


@query(f"WITH RECURSIVE rows AS ({_COUNTS}), mean AS (SELECT avg(x) AS mx FROM rows), {fit_sql.newton('rows', ['x', 'a', 's', 'b'], 'poisson')} {_cell_sql(5, _FOUR)}")
def st_12_cell_limits(spark: Spark, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select("l_linestatus", F.col("l_quantity").alias("y"), (F.col("l_discount") * 10).alias("x"), (F.col("l_returnflag") == "R").cast("string").alias("returned"))
    made = design.model_matrix(rows, ["x", "returned", "l_linestatus", ("returned", "l_linestatus")], ["returned", "l_linestatus"])
    got = design.marginal_means(rows, design.fit_design(rows, "y", made, "poisson"), made, ["returned", "l_linestatus"])
    return got.select("returned", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("cell_mean", "low", "high")], F.round("se", 8).alias("se"))


@query("""WITH x AS (SELECT l_suppkey, (l_returnflag = 'R')::INT AS a, (date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 30)::INT AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT avg(y) FILTER (a = 0) AS p0, avg(y) FILTER (a = 1) AS p1, count(*) AS n, sum(a) AS n1 FROM x),
s AS (SELECT l_suppkey, sum(CASE WHEN a = 1 THEN (y - p1) / n1 ELSE -(y - p0) / (n - n1) END) AS s FROM x, m GROUP BY 1), v AS (SELECT sum(s * s) * count(*) / (count(*) - 1) AS v, count(*) AS g FROM s)
SELECT n, g AS n_clusters, round(p0, 6) AS access_first, round(p1, 6) AS access_second, round(p1 - p0, 6) AS difference, round(p1 - p0 - 1.959963984540054 * sqrt(v), 6) AS low, round(p1 - p0 + 1.959963984540054 * sqrt(v), 6) AS high, round((p1 - p0) / sqrt(v), 4) AS z FROM m, v""")
def st_15_access_difference(spark: Spark, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", (F.col("l_returnflag") == "R").alias("arm"), F.date_diff("l_shipdate", "o_orderdate").alias("days"))
    got = design.access_difference(rows, "days", F.lit(True), F.col("arm"), "l_suppkey", 30)
    return got.select("n", "n_clusters", *[F.round(c, 6).alias(c) for c in ("access_first", "access_second", "difference", "low", "high")], F.round("z", 4).alias("z"))


# residuals -----------------------------------------------------------------------


_U = "(CAST('0x' || substr(md5('3|' || l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
_SUPPLIER_RESIDUALS = f"""l AS (SELECT l_orderkey, l_linenumber, l_quantity AS y, {_U} AS u, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS arm FROM lineitem), lvl AS (SELECT arm, avg(y) AS m FROM l GROUP BY 1),
p AS (SELECT arm, m, CAST(k AS INTEGER) AS k, exp(k * ln(m) - m - lgamma(k + 1)) AS p FROM lvl, range(0, 120) r(k)), c AS (SELECT arm, m, k, sum(p) OVER (PARTITION BY arm ORDER BY k) AS upto, p FROM p),
q AS (SELECT l.*, m, upto - p + u * p AS residual FROM l JOIN c ON c.arm = l.arm AND k = y)"""


def _quantities(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("arm"))


@query(f"WITH {_SUPPLIER_RESIDUALS} SELECT l_orderkey, l_linenumber, round(m, 6) AS mu, round(residual, 6) AS residual FROM q")
def st_20_quantile_residuals(spark: Spark, d: str) -> DataFrame:
    rows = _quantities(spark, d)
    got = residuals.quantile_residuals(rows, fit_one(rows, "y", ["arm"], "poisson"), "y", ["l_orderkey", "l_linenumber"], 3)
    return got.select("l_orderkey", "l_linenumber", F.round("mu", 6).alias("mu"), F.round("residual", 6).alias("residual"))


@query(f"""WITH {_SUPPLIER_RESIDUALS}, s AS (SELECT residual AS x, row_number() OVER (ORDER BY residual) AS i, count(*) OVER () AS n FROM q),
a AS (SELECT sum(pow(y - m, 2) / m) AS pearson, count(*) AS n, count(*) FILTER (y = 0) AS z, sum(exp(-m)) AS e, sum(2 + 1 / m) AS v FROM q)
SELECT 'uniformity' AS test, round(max(greatest(abs(i / n - x), abs(x - (i - 1) / n))), 6) AS statistic, max(n) AS n FROM s UNION ALL SELECT 'dispersion', round(pearson / (n - 2), 6), n FROM a UNION ALL SELECT 'zeros', round(z / e, 6), n FROM a""")
def st_20_residual_tests(spark: Spark, d: str) -> DataFrame:
    rows = _quantities(spark, d)
    got = residuals.residual_tests(rows, fit_one(rows, "y", ["arm"], "poisson"), "y", ["l_orderkey", "l_linenumber"], 3)
    return got.select("test", F.round("statistic", 6).alias("statistic"), "n")


# two random intercepts -----------------------------------------------------------


def _calls(spark: Spark, d: str) -> DataFrame:
    """Lines in orders of customers: two nested groups."""
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("arm"), (F.col("l_linestatus") == "O").cast("int").alias("y"), F.col("l_quantity").cast("int").alias("wait"))
    return lines.join(orders, "l_orderkey")


@query()
def st_04_crossed(spark: Spark, d: str) -> DataFrame:
    rows = _calls(spark, d)
    return stats.effects(rows, crossed.fit_crossed(rows, "y", ["arm"], "o_custkey", "l_orderkey"))


@query()
def st_05_crossed(spark: Spark, d: str) -> DataFrame:
    rows = _calls(spark, d)
    return stats.effects(rows, crossed.fit_crossed(rows, "wait", ["arm"], "o_custkey", "l_orderkey", "negative_binomial"))


@query()
def st_14_crossed_components(spark: Spark, d: str) -> DataFrame:
    rows = _calls(spark, d)
    return crossed.intercept_components(rows, crossed.fit_crossed(rows, "wait", ["arm"], "o_custkey", "l_orderkey", "poisson"), "wait")
