"""Queries of gates and drift: every gate is run on tables that pass and on ones that don't, and reported as rows.

The SQL finds the verdicts from the tables by itself.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import dates
from plinth.operators import aggs, drift, gates, stats
from plinth.plans.registry import query
from plinth.sources import io
from plinth.sources.io import read_table as t

Spark = SparkSession


def _verdicts(spark: Spark, *tried: tuple[str, object]) -> DataFrame:
    return gates.report(spark, tried).select("gate", "passed")


@query("""SELECT 'declared' AS gate, (SELECT min(l_discount) >= 0 AND max(l_discount) <= 100 FROM lineitem) AS passed UNION ALL SELECT 'undeclared', false UNION ALL SELECT 'simulated', false
UNION ALL SELECT 'missing', 'l_discount2' IN (SELECT column_name FROM (DESCRIBE lineitem)) UNION ALL SELECT 'family', (SELECT min(l_extendedprice) >= 0 AND max(l_extendedprice) <= 100 FROM lineitem)""")
def gate_01_provenance(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    plan = {"l_discount": ("measured", "proportion"), "l_tax": ("simulated", "proportion"), "l_discount2": ("measured", "proportion"), "l_extendedprice": ("measured", "proportion")}
    check = lambda c: lambda: gates.provenance_gate(li, plan, [c])
    return _verdicts(spark, ("declared", check("l_discount")), ("undeclared", check("l_quantity")), ("simulated", check("l_tax")), ("missing", check("l_discount2")), ("family", check("l_extendedprice")))


@query("""WITH p AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 0.5) / count(*) OVER () AS u, o_totalprice, o_custkey FROM orders)
SELECT 'count' AS gate, (SELECT min(l_linenumber) >= 0 AND bool_and(l_linenumber = round(l_linenumber)) FROM lineitem) AS passed
UNION ALL SELECT 'broken count', (SELECT bool_and(abs(l_extendedprice - round(l_extendedprice)) < 1e-8) FROM lineitem)
UNION ALL SELECT 'proportion', (SELECT min(l_tax) >= 0 AND max(l_tax) <= 100 FROM lineitem) UNION ALL SELECT 'continuous', (SELECT bool_and(isfinite(c_acctbal)) FROM customer)
UNION ALL SELECT 'percentile', (SELECT min(u) >= 0 AND max(u) <= 1 AND abs(min(u) - 0.01) > 1.5e-8 AND abs(max(u) - 0.99) > 1.5e-8 FROM p)
UNION ALL SELECT 'clamped percentile', (SELECT abs(min(greatest(u, 0.01)) - 0.01) > 1.5e-8 FROM p) UNION ALL SELECT 'skewed percentile', (SELECT count(*) < 30 FROM p) UNION ALL SELECT 'unknown family', false""")
def gate_02_family(spark: Spark, d: str) -> DataFrame:
    from plinth.operators.reshape import sequential_id

    li, c = t(spark, d, "lineitem"), t(spark, d, "customer")
    o = t(spark, d, "orders", ["o_orderkey"])
    p = sequential_id(o, ["o_orderkey"], "n").select(((F.col("n") - 0.5) / o.count()).alias("u"))
    check = lambda df, column, family: lambda: gates.check_family(df, column, family)
    return _verdicts(
        spark, ("count", check(li, "l_linenumber", "count")), ("broken count", check(li, "l_extendedprice", "count")), ("proportion", check(li, "l_tax", "proportion")), ("continuous", check(c, "c_acctbal", "continuous")),
        ("percentile", check(p, "u", "percentile")), ("clamped percentile", check(p.select(F.greatest("u", F.lit(0.01)).alias("u")), "u", "percentile")), ("skewed percentile", check(p.select((F.col("u") * F.col("u")).alias("u")), "u", "percentile")), ("unknown family", check(c, "c_acctbal", "odd")),
    )


@query("""SELECT 'independent' AS gate, true AS passed UNION ALL SELECT 'none missing', true UNION ALL SELECT 'dependent', (SELECT corr((o_orderkey % 2)::DOUBLE, (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0)::INT) IS NULL FROM orders)
UNION ALL SELECT 'three arms', (SELECT count(DISTINCT o_orderkey % 3) = 2 FROM orders)""")
def gate_03_missingness(spark: Spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select((k % 2).cast("string").alias("arm"), (k % 3).cast("string").alias("thirds"), F.when(F.expr("o_orderkey div 2") % 3 != 0, 1).alias("even"), F.lit(1).alias("full"), F.when((k % 2 != 0) | (k % 3 != 0), 1).alias("odd"))
    check = lambda arm, c: lambda: gates.missingness_gate(o, arm, [c])
    return _verdicts(spark, ("independent", check("arm", "even")), ("none missing", check("arm", "full")), ("dependent", check("arm", "odd")), ("three arms", check("thirds", "even")))


_PAIRS = "(SELECT s_suppkey AS pair, a AS arm, s_suppkey <> 3 AS ok FROM supplier, (VALUES ('PE'), ('Non-PE')) v(a))"


@query(f"""SELECT 'whole' AS gate, (SELECT bool_and(ok) AND count(*) = 2 * count(DISTINCT pair) FROM {_PAIRS} WHERE pair <> 3) AS passed UNION ALL SELECT 'not eligible', (SELECT bool_and(ok) FROM {_PAIRS})
UNION ALL SELECT 'half', (SELECT count(*) = 2 * count(DISTINCT pair) FROM {_PAIRS} WHERE ok AND NOT (pair = 5 AND arm = 'PE')) UNION ALL SELECT 'declared count', (SELECT count(*) = 7 FROM supplier WHERE s_suppkey <> 3)""")
def gate_04_population(spark: Spark, d: str) -> DataFrame:
    from plinth.operators.reshape import cross_arms

    p = cross_arms(t(spark, d, "supplier").select(F.col("s_suppkey").alias("pair"), (F.col("s_suppkey") != 3).alias("ok")), ["PE", "Non-PE"])
    good = p.where("pair <> 3")
    check = lambda df, n=None: lambda: gates.population_gate(df, "pair", "arm", "ok", n)
    return _verdicts(spark, ("whole", check(good, good.count() // 2)), ("not eligible", check(p)), ("half", check(good.where("not (pair = 5 and arm = 'PE')"))), ("declared count", check(good, 7)))


@query(r"SELECT 'plan ' || r_regionkey AS gate, regexp_replace('y ~ arm +  ' || r_name, '\s+', ' ', 'g') = 'y ~ arm + ASIA' AS passed FROM region")
def gate_06_plan(spark: Spark, d: str) -> DataFrame:
    used = t(spark, d, "region").select("r_regionkey", "r_name").collect()
    return _verdicts(spark, *[(f"plan {r.r_regionkey}", lambda r=r: gates.plan_gate("y ~ arm + ASIA", f"y  ~ arm +  {r.r_name}")) for r in used])


@query("SELECT 'sourced' AS gate, count(*) = 0 AS passed FROM region WHERE trim(r_name) = '' UNION ALL SELECT 'one without', count(*) = 0 FROM region WHERE r_regionkey = 2")
def gate_07_constants(spark: Spark, d: str) -> DataFrame:
    rows = t(spark, d, "region").collect()
    named = {r.r_name: {"value": r.r_regionkey, "source": r.r_name} for r in rows}
    without = {r.r_name: {"value": r.r_regionkey, "source": " " if r.r_regionkey == 2 else r.r_name} for r in rows}
    return _verdicts(spark, ("sourced", lambda: gates.constants_gate(named)), ("one without", lambda: gates.constants_gate(without)))


@query("SELECT 'current' AS gate, true AS passed UNION ALL SELECT 'changed', sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey)) = sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey) || ' ') FROM region")
def gate_08_digest(spark: Spark, d: str) -> DataFrame:
    plan = "\n".join(r.r_name for r in t(spark, d, "region").orderBy("r_regionkey").collect())
    kept = hashlib.sha256(plan.encode()).hexdigest()
    return _verdicts(spark, ("current", lambda: gates.digest_gate(plan, kept)), ("changed", lambda: gates.digest_gate(plan + " ", kept)))


@query("""WITH s AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT 'whole' AS gate, true AS passed UNION ALL SELECT 'number', (SELECT count(*) = 12 FROM s) UNION ALL SELECT 'size', (SELECT max(n) <= 3 FROM s)
UNION ALL SELECT 'room', (SELECT max(n) <= 1000 FROM s) UNION ALL SELECT 'blank', (SELECT count(*) = 0 FROM orders WHERE o_custkey % 5 = 0)""")
def gate_09_clusters(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").withColumn("gap", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    check = lambda c="o_custkey", **more: lambda: gates.cluster_gate(o, c, **more)
    return _verdicts(spark, ("whole", check()), ("number", check(n_clusters=12)), ("size", check(most=3)), ("room", check(most=1000)), ("blank", check("gap")))


@query("""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT 'same' AS gate, true AS passed UNION ALL SELECT 'near', (SELECT bool_and(abs(n - floor(n * 1.02)) / greatest(floor(n * 1.02), 1) <= 0.05) FROM c)
UNION ALL SELECT 'far', (SELECT bool_and(abs(n - 2 * n) / (2 * n) <= 0.05) FROM c) UNION ALL SELECT 'no such cell', (SELECT count(*) = 0 FROM c WHERE o_orderstatus <> 'O')""")
def gate_10_cells(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    c = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    check = lambda want: lambda: gates.cells_gate(o, ["o_orderstatus"], want)
    return _verdicts(spark, ("same", check(c)), ("near", check(c.withColumn("n", F.floor(F.col("n") * 1.02)))), ("far", check(c.withColumn("n", F.col("n") * 2))), ("no such cell", check(c.where("o_orderstatus = 'O'"))))


@query("""WITH k AS (SELECT DISTINCT c_custkey AS k FROM customer), s AS (SELECT avg((k IN (SELECT o_custkey FROM orders))::INT) AS share FROM k)
SELECT 'all known' AS gate, true AS passed UNION ALL SELECT 'as many as ordered', (SELECT share >= 0.90 FROM s) UNION ALL SELECT 'half', (SELECT share >= 0.30 FROM s) UNION ALL SELECT 'width', (SELECT bool_and(length(CAST(k AS VARCHAR)) = 11) FROM k)""")
def gate_11_geoids(spark: Spark, d: str) -> DataFrame:
    code = lambda df, c: df.select(F.lpad(F.col(c).cast("string"), 11, "0").alias("geoid")).distinct()
    c, o = code(t(spark, d, "customer"), "c_custkey"), code(t(spark, d, "orders"), "o_custkey")
    short = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("geoid"))
    check = lambda a, b, **more: lambda: gates.geoid_gate(a, b, "geoid", **more)
    return _verdicts(spark, ("all known", check(c, c)), ("as many as ordered", check(c, o)), ("half", check(c, o, least=0.30)), ("width", check(short, short)))


@query("""WITH g AS (SELECT p_partkey AS pairs, 2 * p_partkey AS people, CASE WHEN p_partkey % 10 = 0 THEN p_partkey ELSE 4 * p_partkey END AS calls, p_size / 50.0 AS power, p_size AS fits FROM part)
SELECT 'sums' AS gate, (SELECT bool_and(people = 2 * pairs AND calls = 2 * people AND power BETWEEN 0 AND 1 AND fits > 0) FROM g WHERE pairs % 10 <> 0) AS passed
UNION ALL SELECT 'broken sums', (SELECT bool_and(calls = 2 * people) FROM g) UNION ALL SELECT 'range', (SELECT bool_and(power + 0.5 <= 1) FROM g WHERE pairs % 10 <> 0) UNION ALL SELECT 'no fits', false""")
def gate_12_power_table(spark: Spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    g = t(spark, d, "part").select(k.alias("Pairs"), (2 * k).alias("Physicians"), F.when(k % 10 == 0, k).otherwise(4 * k).alias("Total_Calls"), (F.col("p_size") / 50.0).alias("Power"), F.col("p_size").alias("Usable_Fits"))
    good = g.where("Pairs % 10 <> 0")
    check = lambda df: lambda: gates.power_table_gate(df)
    return _verdicts(spark, ("sums", check(good)), ("broken sums", check(g)), ("range", check(good.withColumn("Power", F.col("Power") + 0.5))), ("no fits", check(good.withColumn("Usable_Fits", F.lit(0)))))


@query("SELECT 'named' AS gate, (SELECT count(*) = 0 FROM nation WHERE upper(trim(n_name)) IN ('', 'TODO', 'TBD', 'UNKNOWN', '?')) AS passed UNION ALL SELECT 'placeholder', (SELECT count(*) = 0 FROM nation WHERE n_nationkey = 6)")
def gate_13_sources(spark: Spark, d: str) -> DataFrame:
    n = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("source"))
    todo = n.withColumn("source", F.when(F.col("n_nationkey") == 6, " todo ").otherwise(F.col("source")))
    return _verdicts(spark, ("named", lambda: gates.sources_gate(n)), ("placeholder", lambda: gates.sources_gate(todo)))


@query("SELECT 'calendar' AS gate, true AS passed UNION ALL SELECT 'off by one', (SELECT count(*) = 0 FROM orders)")
def gate_14_business_days(spark: Spark, d: str) -> DataFrame:
    # Orders are moved into the years of the calendar.
    o = t(spark, d, "orders").select(F.to_date(F.add_months("o_orderdate", 12 * 28)).alias("a"), F.date_add(F.add_months("o_orderdate", 12 * 28), (F.col("o_orderkey") % 40).cast("int")).alias("b"))
    made = dates.add_business_days(o, "a", "b")
    wrong = made.withColumn("business_days", F.coalesce(F.col("business_days") + 1, F.lit(0)))
    return _verdicts(spark, ("calendar", lambda: gates.business_days_gate(made, "a", "b", "business_days")), ("off by one", lambda: gates.business_days_gate(wrong, "a", "b", "business_days")))


@query("""WITH f AS (SELECT 1 AS i, 'discount' AS gate, (SELECT max(l_discount) <= 100 AND min(l_discount) >= 0 FROM lineitem) AS ok UNION ALL SELECT 2, 'line number', (SELECT min(l_linenumber) >= 0 FROM lineitem)
UNION ALL SELECT 3, 'clusters', (SELECT max(n) <= 2 FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) UNION ALL SELECT 4, 'never', true)
SELECT gate, CASE WHEN i < (SELECT min(i) FROM f WHERE NOT ok) THEN 'passed' WHEN i = (SELECT min(i) FROM f WHERE NOT ok) THEN 'failed' ELSE 'not run' END AS status FROM f""")
def gate_15_preflight(spark: Spark, d: str) -> DataFrame:
    c, li = t(spark, d, "customer"), t(spark, d, "lineitem")
    ran = []

    def noted(name, gate):
        def run():
            ran.append(name)
            gate()

        return name, run

    tried = [
        noted("discount", lambda: gates.check_family(li, "l_discount", "proportion")),
        noted("line number", lambda: gates.check_family(li, "l_linenumber", "count")),
        noted("clusters", lambda: gates.cluster_gate(c, "c_nationkey", most=2)),
        noted("never", lambda: None),
    ]
    try:
        gates.preflight(tried)
        failed = None
    except io.ContractError:
        failed = ran[-1]
    return spark.createDataFrame([(n, "failed" if n == failed else "passed" if n in ran else "not run") for n, _ in tried], "gate string, status string")


@query("""WITH r AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1), x AS (SELECT sum(pow(l_quantity - m, 2) / m) / (count(*) - 3) AS phi FROM lineitem JOIN r USING (l_returnflag))
SELECT 'dispersed' AS gate, (SELECT phi <= 1.5 FROM x) AS passed UNION ALL SELECT 'allowed', (SELECT phi <= 1000 FROM x) UNION ALL SELECT 'converged', true UNION ALL SELECT 'not converged', false""")
def gate_16_st_16_17_fit_gates(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_returnflag") == "A").cast("int").alias("a"), "l_quantity")
    fit = stats.fit_glm(li, "l_quantity", ["r", "a"], "poisson")
    few = {**fit, "converged": False}
    return _verdicts(
        spark, ("dispersed", lambda: stats.overdispersion_gate(li, fit, "l_quantity")), ("allowed", lambda: stats.overdispersion_gate(li, fit, "l_quantity", most=1000)), ("converged", lambda: stats.convergence_gate(fit)), ("not converged", lambda: stats.convergence_gate(few))
    )


@query("SELECT 'known_forms' AS rule, 'unknown form' AS detail, count(*) AS n FROM (SELECT unnest(['ASIA', 'CALL', 'VISIT']) AS f) WHERE f NOT IN (SELECT r_name FROM region)")
def row_09_known_forms(spark: Spark, d: str) -> DataFrame:
    r = t(spark, d, "region")
    record = r.select("r_regionkey", *[F.lit(1).alias(f"{n}_complete") for n in ("ASIA", "CALL", "VISIT")])
    return gates.rule_known_forms(record, r, "r_name")


@query("""WITH want AS (SELECT n_name AS label, 'S' || n_regionkey AS scale FROM nation WHERE n_nationkey % 5 <> 0), used AS (SELECT n_name AS label, 'S' || (n_regionkey + (n_nationkey % 3 = 0)::INT) AS scale, n_nationkey % 4 = 0 AS lit FROM nation WHERE n_nationkey % 7 <> 0)
SELECT w.label, 'orphaned' AS finding FROM want w WHERE label NOT IN (SELECT label FROM used) UNION ALL SELECT label, 'unknown' FROM used WHERE label NOT IN (SELECT label FROM want)
UNION ALL SELECT w.label, 'scale_drift' FROM want w JOIN used u USING (label) WHERE w.scale <> u.scale UNION ALL SELECT label, 'hard_coded' FROM used WHERE lit""")
def drf_01_estimand_drift(spark: Spark, d: str) -> DataFrame:
    n, k = t(spark, d, "nation"), F.col("n_nationkey")
    scale = lambda c: F.concat(F.lit("S"), c.cast("string"))
    want = n.where(k % 5 != 0).select(F.col("n_name").alias("label"), scale(F.col("n_regionkey")).alias("scale"))
    used = n.where(k % 7 != 0).select(F.col("n_name").alias("label"), scale(F.col("n_regionkey") + (k % 3 == 0).cast("int")).alias("scale"), (k % 4 == 0).alias("is_literal"))
    return drift.estimand_drift(want, used)


@query("""SELECT n_name AS step, CASE WHEN n_regionkey = 0 THEN 'no_timeout' WHEN n_nationkey > 15 THEN 'timeout_too_long' WHEN n_nationkey % 4 = 0 THEN 'may_fail' END AS finding FROM nation WHERE n_nationkey % 3 <> 0 AND (n_regionkey = 0 OR n_nationkey > 15 OR n_nationkey % 4 = 0)""")
def drf_03_ci_contract(spark: Spark, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    steps = t(spark, d, "nation").select(F.col("n_name").alias("step"), (k % 3 != 0).alias("is_blocking"), F.when(F.col("n_regionkey") != 0, k).alias("timeout_minutes"), (k % 4 == 0).alias("continue_on_error"))
    return drift.ci_contract(steps)


@query("SELECT 'contacted' AS gate, true AS passed UNION ALL SELECT 'contaminated', (SELECT count(*) = 0 FROM orders WHERE o_orderstatus <> 'O')")
def drf_04_waits(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").withColumns({"wait": F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")), "always": F.col("o_totalprice")})
    contacted = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus") == "O")
    return _verdicts(spark, ("contacted", lambda: gates.waits_gate(o, "wait", contacted)), ("contaminated", lambda: gates.waits_gate(o, "always", contacted)))


@query("""WITH n AS (SELECT (SELECT count(*) FROM lineitem) AS a, (SELECT count(*) FROM orders) AS b, (SELECT count(*) FROM customer) AS c) SELECT 'falls' AS gate, a >= b AND b >= c AS passed FROM n UNION ALL SELECT 'grows', c >= b FROM n UNION ALL SELECT 'not resolved', false""")
def drf_06_funnel(spark: Spark, d: str) -> DataFrame:
    a, b, c = (t(spark, d, x).count() for x in ("lineitem", "orders", "customer"))
    check = lambda *counts: lambda: aggs.checked_funnel(counts)
    return _verdicts(spark, ("falls", check(("lines", a), ("orders", b), ("customers", c))), ("grows", check(("customers", c), ("orders", b))), ("not resolved", check(("lines", a), ("orders", None))))


@query(r"""WITH l AS (SELECT unnest(['library(' || replace(p_name, ' ', '.') || ')  # require(none)', 'x <- ' || replace(p_type, ' ', '.') || '::f(1)']) AS line FROM part),
c AS (SELECT regexp_replace(line, '#.*$', '') AS line FROM l) SELECT DISTINCT p AS package FROM (SELECT unnest(list_concat(regexp_extract_all(line, '\blibrary\(\s*([A-Za-z][\w.]*)', 1), regexp_extract_all(line, '\b([A-Za-z][\w.]*):::?[A-Za-z.]', 1))) AS p FROM c)""")
def str_33_loaded_packages(spark: Spark, d: str) -> DataFrame:
    p = t(spark, d, "part")
    dotted = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("."))
    lines = p.select(F.explode(F.array(F.concat(F.lit("library("), dotted("p_name"), F.lit(")  # require(none)")), F.concat(F.lit("x <- "), dotted("p_type"), F.lit("::f(1)")))).alias("value"))
    return drift.loaded_packages(lines)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def gate_06_plan_drift(spark: Spark, d: str) -> DataFrame:
    """Texts declared against texts used: white space alone is no drift, a further word is."""
    used = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", " ", " \n ")).otherwise(F.col("text"))
    return gates.plan_drift(t(spark, d, "documents").select("doc_id", "text", used.alias("used")), "doc_id", "text", "used")


@query("SELECT p_partkey FROM part WHERE p_size % 10 IN (0, 1)")
def gate_07_unsourced(spark: Spark, d: str) -> DataFrame:
    source = F.when(F.col("p_size") % 10 == 0, "  ").when(F.col("p_size") % 10 > 1, F.col("p_brand"))
    return gates.unsourced(t(spark, d, "part").select("p_partkey", source.alias("source")), "p_partkey", "source")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 IN (0, 1)")
def gate_08_digest_drift(spark: Spark, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 != 1, F.upper(F.sha2("text", 256))).alias("kept"))
    now = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return gates.digest_drift(now, "doc_id", "text", "kept")
