"""Queries of scans and sinks: tables are written to the shared folder, read back and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import dates, geo, keys, scalars
from plinth.operators import aggs, filters, joins, reshape, stats
from plinth.operators.lineage import scratch_path
from plinth.plans.registry import query
from plinth.sources import io
from plinth.sources.io import read_table as t

Spark = SparkSession

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _lines(df: DataFrame, name: str) -> str:
    """The path of a text table of one column."""
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


# scans -------------------------------------------------------------------------


@query("SELECT * FROM customer")
def src_01_declared_csv(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    io.write_csv(t(spark, d, "customer"), path)
    return io.read_csv(spark, path, CUSTOMER)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'NA' ELSE '' END AS mark, c_mktsegment FROM customer")
def src_02_string_csv(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    mark = F.when(F.col("c_nationkey") % 2 == 0, "NA").otherwise("")
    io.write_csv(t(spark, d, "customer").select("c_custkey", mark.alias("mark"), "c_mktsegment"), path)
    return io.read_csv_strings(spark, path)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src_05_pipe_separated(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "psv")
    t(spark, d, "supplier").write.option("sep", "|").option("header", True).csv(path)
    return io.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", sep="|")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation")
def src_06_headless(spark: Spark, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    titles = spark.createDataFrame([("List of nations", ""), ("code", "name")], "code string, name string")
    path = scratch_path(spark, "headless")
    titles.unionByName(n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))).write.csv(path)
    return io.read_headless(spark, path, ["code", "name"], ~F.col("code").rlike(r"^\d+$"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src_07_json(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "json")
    io.write_json(t(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), path)
    return io.read_json(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string", multiline=False)


@query(r"SELECT count(*) AS n_lines, count(*) FILTER (starts_with(l, 'x')) AS n_x FROM (SELECT unnest(string_split(chr(10) || 'x' || p_name || chr(10) || p_type, chr(10))) AS l FROM part) WHERE l <> ''")
def src_19_lines(spark: Spark, d: str) -> DataFrame:
    path = _lines(t(spark, d, "part").select(F.concat(F.lit("x"), "p_name", F.lit("\n"), "p_type").alias("value")), "lines")
    return io.read_lines(spark, path).agg(F.count("*").alias("n_lines"), F.count_if(F.col("value").startswith("x")).alias("n_x"))


@query("SELECT 'nation ' || n_nationkey AS key, n_name || ' = ' || n_regionkey AS value FROM nation")
def src_18_settings(spark: Spark, d: str) -> DataFrame:
    line = F.concat(F.lit(" nation "), F.col("n_nationkey").cast("string"), F.lit(" =  "), "n_name", F.lit(" = "), F.col("n_regionkey").cast("string"), F.lit("\n# comment\n"))
    return io.read_settings(spark, _lines(t(spark, d, "nation").select(line.alias("value")), "settings"))


@query("SELECT replace(p_name, ' ', '_') AS package, p_size || '.0' AS version, p_type AS rest FROM part")
def src_18_records(spark: Spark, d: str) -> DataFrame:
    line = F.concat_ws("  ", F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.col("p_size").cast("string"), F.lit(".0")), "p_type")
    return io.read_records(spark, _lines(t(spark, d, "part").select(F.concat(line, F.lit("\n# x\n")).alias("value")), "records"), ["package", "version", "rest"])


@query("SELECT 'orders' AS name, count(*) >= 10 AS is_there FROM orders UNION ALL SELECT 'nation', count(*) >= 1000 FROM nation UNION ALL SELECT 'nowhere', false")
def src_09_required_tables(spark: Spark, d: str) -> DataFrame:
    rows = []
    for name, least in (("orders", 10), ("nation", 1000), ("nowhere", 1)):
        try:
            io.require_tables(spark, d, {name: least})
            rows.append((name, True))
        except io.ContractError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, is_there boolean")


_PLACES = "SELECT DISTINCT n_nationkey, upper(trim(n_name)) AS city, 'R' || n_regionkey AS state, n_nationkey * 2.0 AS lat, n_regionkey * 10.0 AS lon FROM nation"


def _places(spark: Spark, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    place = n.select(F.concat(F.lit("  "), F.lower("n_name")).alias("City"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("State"), (F.col("n_nationkey") * 2.0).alias("Latitude"), (F.col("n_regionkey") * 10.0).alias("lng"))
    later = place.withColumn("Latitude", F.col("Latitude") + 500)  # a later row of the same place does not count
    return geo.gazetteer(place.unionByName(later).unionByName(place.withColumn("lng", F.lit(None).cast("double"))), "City", "State")


@query(f"SELECT city, state, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({_PLACES})")
def src_21_gazetteer(spark: Spark, d: str) -> DataFrame:
    return _places(spark, d)


@query(f"""WITH p AS ({_PLACES}) SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 1.5 WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(lat AS DOUBLE) END AS lat, CASE WHEN c_nationkey = 3 THEN 2.5 WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(lon AS DOUBLE) END AS lon,
CASE WHEN c_nationkey = 3 THEN 'override' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'gazetteer' END AS coordinates_via FROM customer JOIN p ON c_nationkey = n_nationkey""")
def mat_02_place_coordinates(spark: Spark, d: str) -> DataFrame:
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("town"), F.concat(F.lit(" R"), F.col("n_regionkey").cast("string")).alias("region"))
    c = t(spark, d, "customer", ["c_custkey", "c_nationkey"]).join(n, "c_nationkey")
    c = c.withColumn("town", F.when((F.col("c_custkey") % 7 == 0) & (F.col("c_nationkey") != 3), "Atlantis").otherwise(F.col("town")))
    overrides = n.where("c_nationkey = 3").select(geo.place_key(F.col("town")).alias("city"), geo.place_key(F.col("region")).alias("state"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    return geo.with_coordinates(c, "town", "region", _places(spark, d), overrides).select("c_custkey", "lat", "lon", "coordinates_via")


# sinks -------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(CASE WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END, 'missing') AS c_mktsegment FROM customer")
def snk_01_csv_with_null_mark(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    c = t(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_nationkey") != 5, F.col("c_mktsegment")))
    io.write_csv(c, path, ["c_custkey", "c_mktsegment"], null_value="missing")
    return io.read_csv(spark, path, "c_custkey long, c_mktsegment string")


@query("SELECT count(*) AS n, count(*) FILTER (k < b) AS n_falls, true AS refuses FROM (SELECT o_orderkey AS k, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def snk_02_sorted_csv(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "sorted")
    io.write_sorted(t(spark, d, "orders"), path, ["o_orderkey", "o_totalprice"], ["o_orderkey"])
    try:
        io.write_sorted(t(spark, d, "orders"), path, ["o_orderkey"], ["o_orderkey"])
        refuses = False
    except Exception:
        refuses = True
    back = spark.read.schema("o_orderkey long, o_totalprice double").option("header", True).csv(path).withColumn("_at", F.concat(F.input_file_name(), F.format_string("%020d", F.monotonically_increasing_id())))
    # Along the files and their lines the key never falls: the greatest of each file is below the least of the next.
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    falls = files.alias("a").join(files.alias("b"), (F.col("a.f") < F.col("b.f")) & (F.col("a.high") >= F.col("b.low"))).count()
    return files.agg(F.sum("n").alias("n")).select("n", F.lit(falls).cast("long").alias("n_falls"), F.lit(refuses).alias("refuses"))


@query("SELECT event_id, event_type, value FROM events")
def snk_03_json(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "json")
    io.write_json(t(spark, d, "events", ["event_id", "event_type", "value"]), path)
    return spark.read.schema("event_id long, event_type string, value double").json(path)


@query("SELECT 'now' AS state, count(*) FILTER (c_nationkey <> 2 AND c_nationkey <> 1) AS n FROM customer UNION ALL SELECT 'original', count(*) FROM customer UNION ALL SELECT 'dry', count(*) FROM customer")
def snk_04_replace_with_backup(spark: Spark, d: str) -> DataFrame:
    path = scratch_path(spark, "replaced")
    c = t(spark, d, "customer")
    io.replace_table(c, path, apply=True)
    plan = io.replace_table(c.where("c_nationkey > 99"), path)  # dry run
    states = {"dry": spark.read.parquet(plan["path"]).count()}
    for gone in (1, 2):
        io.replace_table(spark.read.parquet(path).where(F.col("c_nationkey") != gone), path, apply=True, backup="once")
    states |= {"now": spark.read.parquet(path).count(), "original": spark.read.parquet(f"{path}.original").count()}
    return spark.createDataFrame(list(states.items()), "state string, n long")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'rich', count(*) FROM customer WHERE c_acctbal > 9000")
def snk_05_bundle(spark: Spark, d: str) -> DataFrame:
    folder = scratch_path(spark, "bundle")
    io.write_bundle({"nation": t(spark, d, "nation"), "rich": t(spark, d, "customer").where("c_acctbal > 9000")}, folder)
    return reshape.stack({n: t(spark, folder, n).agg(F.count("*").alias("n")) for n in ("nation", "rich")}, "name", ["n"])


@query("SELECT 'out' AS output, 'output' AS role, 'out' AS name, count(*) AS n_rows, true AS is_repeatable FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'out', 'source', 'customer', count(*), true FROM customer UNION ALL SELECT 'out', 'source', 'nation', count(*), true FROM nation")
def snk_07_provenance(spark: Spark, d: str) -> DataFrame:
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    made = c.where("c_acctbal > 0")
    first = io.provenance(made, "out", {"customer": c, "nation": n}, "run 1")
    again = io.provenance(made.orderBy(F.desc("c_custkey")), "out", {"customer": c.repartition(3), "nation": n}, "run 2").select("name", F.col("digest").alias("_again"))
    return first.join(again, "name").select("output", "role", "name", "n_rows", (F.col("digest") == F.col("_again")).alias("is_repeatable"))


@query("""SELECT CAST(1 AS BIGINT) AS pos, 'Customers' AS line UNION ALL SELECT 2, 'by key' UNION ALL SELECT 2 + row_number() OVER (ORDER BY c_custkey), '"' || c_custkey || '","' || c_name || '"' FROM customer""")
def snk_09_titled_sheet(spark: Spark, d: str) -> DataFrame:
    return io.titled_sheet(t(spark, d, "customer"), ["Customers", "by key"], ["c_custkey", "c_name"], ["c_custkey"])


@query("""WITH n AS (SELECT n_nationkey + 1.0 AS p, n_name, CASE WHEN n_nationkey = 4 THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 10.5, 'New', NULL)
SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS pos, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM n""")
def snk_10_dictionary_edit(spark: Spark, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    names = {r.n_nationkey: r.n_name for r in n.where("n_nationkey in (4, 7, 9)").collect()}
    rows = n.select((F.col("n_nationkey") + 1).alias("pos"), "n_name", "n_regionkey")
    return io.edit_dictionary(rows, "pos", "n_name", {names[4]: {"n_regionkey": "99"}}, [names[7]], {names[9]: {"n_name": "New"}}).select("pos", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT unnest(['# Regions', '', '| r_regionkey | r_name |', '|---|---|']) AS line UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region UNION ALL SELECT ''")
def snk_11_markdown(spark: Spark, d: str) -> DataFrame:
    text = io.report_lines(t(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions")
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


# small projections, filters and summaries ----------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def prj_03_drop_if_there(spark: Spark, d: str) -> DataFrame:
    return reshape.without(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment", "no_such_column"])


@query("SELECT c_custkey AS found, CAST(NULL AS VARCHAR) AS missing FROM customer")
def prj_08_column_in_any_case(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "C_CustKey")
    return c.select(F.col(io.column_named(c, "c_custkey")).alias("found"), F.lit(io.column_named(c, "custkey")).cast("string").alias("missing"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1, 2) AS plain, c_custkey % 4 IN (0, 1) AS literal FROM customer")
def flt_05_blank(spark: Spark, d: str) -> DataFrame:
    r = F.col("c_custkey") % 4
    c = F.when(r == 1, "").when(r == 2, "na").when(r == 3, "x")
    return t(spark, d, "customer").select("c_custkey", keys.is_blank(c, ("NA",)).alias("plain"), keys.is_blank(c, ()).alias("literal"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '555-' || c_custkey WHEN 1 THEN '777-' || c_custkey END AS phone FROM customer")
def flt_06_any_phone(spark: Spark, d: str) -> DataFrame:
    r, k = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    first = F.when(r == 0, F.concat(F.lit("555-"), k)).otherwise(F.lit("N/A"))
    second = F.when(r == 1, F.concat(F.lit("777-"), k)).otherwise(F.lit(""))
    return t(spark, d, "customer").select("c_custkey", keys.first_usable([first, second]).alias("phone"))


@query("SELECT p_partkey, p_partkey % 4 < 2 AS is_family FROM part")
def flt_08_prefix_family(spark: Spark, d: str) -> DataFrame:
    r = F.col("p_partkey") % 4
    label = keys.taxonomy_subspecialty(F.when(r == 0, "207V00000X").when(r == 1, "207VX0201X").when(r == 2, "208D00000X"))
    return t(spark, d, "part").select("p_partkey", (~label.isin("Unknown", "Not OB-GYN")).alias("is_family"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 = 0 OR NOT regexp_matches(lower(p_type), 'steel|tin')")
def flt_09_not_matching(spark: Spark, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")))
    return p.where(filters.not_matching(F.col("p_type"), "STEEL|tin")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0")
def flt_13_complete(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumns({"a": F.when(F.col("c_custkey") % 3 != 0, 1), "b": F.when(F.col("c_custkey") % 4 != 0, 1)})
    return filters.complete(c, ["a", "b"]).select("c_custkey")


@query("SELECT round(ln((count(*) FILTER (l_linestatus = 'F')) / (count(*) FILTER (l_linestatus = 'O'))), 5) AS log_odds FROM lineitem WHERE l_returnflag = 'R'")
def flt_14_model_subset(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_linestatus") == "F").cast("int").alias("y"))
    return spark.createDataFrame([(round(stats.fit_glm(li, "y", [])["coefficients"][0], 5),)], "log_odds double")


@query("SELECT true AS stops")
def flt_15_retired(spark: Spark, d: str) -> DataFrame:
    try:
        filters.refuse("retired")
        stops = False
    except io.ContractError:
        stops = True
    return t(spark, d, "region").limit(1).select(F.lit(stops).alias("stops"))


@query("SELECT n_left, n_matched, round(n_matched / n_left, 6) AS coverage, n_right_keys, n_repeated_keys, round(n_out / n_left, 6) AS growth FROM (SELECT count(*) AS n_left, count(n) AS n_matched, sum(coalesce(n, 1)) AS n_out FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey), (SELECT count(*) AS n_right_keys, count(*) FILTER (n > 1) AS n_repeated_keys FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))")
def joi_24_join_report(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.join_report(t(spark, d, "customer"), o, ["c_custkey"]).select("n_left", "n_matched", F.round("coverage", 6).alias("coverage"), "n_right_keys", "n_repeated_keys", F.round("growth", 6).alias("growth"))


@query("""WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT sum(coalesce(n, 1)) / count(*) AS growth, count(n) / count(*) AS coverage, count(n) FILTER (c_custkey <= 3) / count(*) AS few FROM customer LEFT JOIN k ON o_custkey = c_custkey)
SELECT 'repeated' AS what, (SELECT max(n) > 1 FROM k) AS stops UNION ALL SELECT 'growth', growth > 1.5 FROM g UNION ALL SELECT 'coverage', few < 0.9 FROM g UNION ALL SELECT 'fits', growth > 100 OR coverage < 0.3 FROM g""")
def joi_24_ceilings(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer", ["c_custkey"])
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    few = o.where("c_custkey <= 3")
    rows = []
    for name, options in (("repeated", {"right": o}), ("growth", {"right": o, "unique": False, "max_growth": 1.5}), ("coverage", {"right": few, "unique": False, "min_coverage": 0.9}), ("fits", {"right": o, "unique": False, "max_growth": 100.0, "min_coverage": 0.3})):
        try:
            joins.safe_join(c, on=["c_custkey"], **options)
            rows.append((name, False))
        except io.ContractError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "what string, stops boolean")


@query("SELECT l_suppkey, min(l_shipdate) AS first_shipped, min(l_returnflag) AS any_flag FROM lineitem GROUP BY 1")
def agg_03_min_and_any(spark: Spark, d: str) -> DataFrame:
    # "Any value" is the least one, so that it does not hang on row order.
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_shipped"), F.min("l_returnflag").alias("any_flag"))


@query("SELECT p_brand, min(v) AS lowest, max(v) AS highest, count(DISTINCT v) AS n_distinct FROM (SELECT p_brand, CASE WHEN p_brand <> 'Brand#11' AND p_partkey % 3 > 0 THEN p_size END AS v FROM part) GROUP BY 1")
def agg_05_06_null_aware(spark: Spark, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("v", F.when((F.col("p_brand") != "Brand#11") & (F.col("p_partkey") % 3 > 0), F.col("p_size")))
    return p.groupBy("p_brand").agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.count_distinct("v").alias("n_distinct"))


@query("SELECT count(*) AS n, count(l_quantity) AS n_valid, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, median(l_quantity) AS median, min(l_quantity) AS lowest, max(l_quantity) AS highest FROM lineitem")
def agg_16_global_summary(spark: Spark, d: str) -> DataFrame:
    s = aggs.summary(t(spark, d, "lineitem"), [], "l_quantity")
    return s.select("n", "n_valid", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median", "lowest", "highest")


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS geoid, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def agg_21_sum_by_geoid(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("geoid")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT c_mktsegment, n, CAST(row_number() OVER (ORDER BY n DESC, c_mktsegment) AS INTEGER) AS place FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def agg_27_ranked_counts(spark: Spark, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    counts = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "c_mktsegment")))  # one row for each segment


_FITS = "(SELECT p_size % 5 AS cell, CASE WHEN p_partkey % 11 > 0 THEN p_retailprice / 1000 END AS b, p_retailprice / 1000 - 0.3 AS low, p_retailprice / 1000 + 0.3 AS high, p_partkey % 20 / 100.0 AS p FROM part)"


@query(f"SELECT cell, count(*) AS n_fits, count(b) AS n_usable, count(*) - count(b) AS n_not_estimable, round(avg(b) - 1.2, 6) AS bias, round(avg(CASE WHEN b IS NOT NULL THEN (1.2 BETWEEN low AND high)::INT END), 6) AS coverage, round(avg(CASE WHEN b IS NOT NULL THEN (p < 0.05)::INT END), 6) AS power FROM {_FITS} GROUP BY 1")
def agg_29_30_fits(spark: Spark, d: str) -> DataFrame:
    est = F.col("p_retailprice") / 1000
    fits = t(spark, d, "part").select((F.col("p_size") % 5).alias("cell"), F.when(F.col("p_partkey") % 11 > 0, est).alias("b"), (est - 0.3).alias("low"), (est + 0.3).alias("high"), (F.col("p_partkey") % 20 / 100.0).alias("p"))
    s = aggs.simulation_summary(fits, ["cell"], "b", "low", "high", "p", 1.2)
    return s.select("cell", "n_fits", "n_usable", "n_not_estimable", *[F.round(c, 6).alias(c) for c in ("bias", "coverage", "power")])


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_quantity - 25), l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def srt_05_arg_min(spark: Spark, d: str) -> DataFrame:
    best = joins.best_candidate(t(spark, d, "lineitem"), ["l_suppkey"], F.abs(F.col("l_quantity") - 25), ["l_orderkey", "l_linenumber", "l_partkey"])
    return best.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY 1")
def set_05_unique_in_order(spark: Spark, d: str) -> DataFrame:
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ">").alias("roles"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def dat_04_run_stamp(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", dates.run_stamp(F.col("o_orderdate")).alias("stamp"))


@query("SELECT event_id, round((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts)))) / 3600, 4) AS hours_since, coalesce(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) >= 48 * 3600, true) AS is_spaced FROM events")
def dat_05_spacing(spark: Spark, d: str) -> DataFrame:
    return dates.spaced(t(spark, d, "events"), ["user_id"], "ts").select("event_id", F.round("hours_since", 4).alias("hours_since"), "is_spaced")


@query("SELECT c_custkey, c_custkey % 5 IN (0, 1) AS usable FROM customer")
def mat_10_usable_number(spark: Spark, d: str) -> DataFrame:
    r = F.col("c_custkey") % 5
    v = F.when(r == 0, "1.5").when(r == 1, "-3").when(r == 2, "0").when(r == 3, "Infinity").otherwise("x")
    return t(spark, d, "customer").select("c_custkey", scalars.usable_number(v).alias("usable"))


@query("SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS pick FROM orders GROUP BY 1")
def arr_04_primary_or_first(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("a"))
    return o.select("o_custkey", scalars.first_where(F.col("a"), lambda x: x["o_orderstatus"] == "F")["o_orderkey"].alias("pick"))


@query("SELECT c_mktsegment AS stratum, 'balance' AS variable, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 4) AS pct_negative FROM customer GROUP BY 1")
def st_25_table_one(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    s = aggs.summary(c, ["c_mktsegment"], "c_acctbal").join(aggs.rates(c, ["c_mktsegment"], {"negative": F.col("c_acctbal") < 0}).drop("n"), "c_mktsegment")
    return s.select(F.col("c_mktsegment").alias("stratum"), F.lit("balance").alias("variable"), "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(100 * F.col("rate_negative"), 4).alias("pct_negative"))


# practices and rosters -------------------------------------------------------------


def _platform_pages(spark: Spark, d: str) -> DataFrame:
    """A page for each supplier: linked data, a marker object, or meta tags and visible text, by platform."""
    k = F.col("s_suppkey")
    s, n = k.cast("string"), F.concat(F.lit("Clinic "), F.col("s_suppkey").cast("string"))
    phone = F.concat(F.lit("("), F.lpad(F.pmod(k * 37, F.lit(800)).cast("string"), 3, "2"), F.lit(") 555-"), F.lpad(F.pmod(k, F.lit(10000)).cast("string"), 4, "0"))
    team = F.concat(F.lit('<a href="/team/dr-'), s, F.lit('">A</a><a href="/blog/x">B</a><a href="/team/dr-'), s, F.lit('">A</a><a href="/team/second">C</a>'))
    data = F.concat(F.lit('{"name": "'), n, F.lit('", "address": {"streetAddress": "'), s, F.lit(' Elm St", "addressLocality": "Denver", "addressRegion": "CO"}, "telephone": "'), phone, F.lit('"}'))
    linked = F.concat(F.lit('<html><head><title>x</title><script type="application/ld+json">'), data, F.lit("</script></head><body>"), team, F.lit("</body></html>"))
    marked = F.concat(F.lit("<html><script>window.__data = "), data, F.lit("; go({})</script>"), team, F.lit("</html>"))
    plain = F.concat(F.lit('<html><head><title>Home</title><meta property="og:site_name" content="'), n, F.lit('"></head><body><p>9 Oak Rd, Boulder, CO 80301</p><p>Call '), phone, F.lit("</p>"), team, F.lit("</body></html>"))
    html = F.when(k % 3 == 0, linked).when(k % 3 == 1, marked).otherwise(plain)
    return t(spark, d, "supplier").select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("platform"), html.alias("html"), F.concat(F.lit("https://c"), s, F.lit(".example.com/")).alias("url"))


def _found(spark: Spark, d: str) -> DataFrame:
    from plinth.operators.practices import Platform, practices

    return practices(_platform_pages(spark, d), [Platform("p0", provider_path="^/team/"), Platform("p1", marker="window.__data =", provider_path="^/team/"), Platform("p2", provider_path="^/team/", defaults=(("address", "on request"),))])


@query("""SELECT 'p' || (s_suppkey % 3) AS platform, 'Clinic ' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 2 THEN 'Boulder' ELSE 'Denver' END AS city, 'CO' AS state, CASE WHEN s_suppkey % 3 = 2 THEN 'on request' ELSE s_suppkey || ' Elm St' END AS address,
lpad(CAST((s_suppkey * 37) % 800 AS VARCHAR), 3, '2') || '-555-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS phone, 'https://c' || s_suppkey || '.example.com/' AS url FROM supplier""")
def str_24_26_36_practices(spark: Spark, d: str) -> DataFrame:
    return _found(spark, d).drop("provider_urls")


@query("SELECT 'p' || (s_suppkey % 3) AS platform, 'https://c' || s_suppkey || '.example.com/' AS practice_url, unnest(['/team/dr-' || s_suppkey, '/team/second']) AS provider_url FROM supplier")
def str_36_provider_links(spark: Spark, d: str) -> DataFrame:
    from plinth.operators.practices import provider_links

    return provider_links(_found(spark, d))


_ROSTER = "SELECT 'p' || (c_custkey % 4) AS platform, '/team/' || c_custkey AS provider_url, 'Ann' || (c_custkey % 50) || ' Lee' || c_nationkey AS provider_name, CASE c_custkey % 3 WHEN 0 THEN 'MD' WHEN 1 THEN 'DO' ELSE 'CNM' END AS credentials, 'S' || (c_nationkey % 5) AS state, c_custkey FROM customer"


@query(f"""WITH c AS ({_ROSTER}), o AS (SELECT *, 'retained' AS origin FROM c WHERE platform <> 'p1' UNION ALL SELECT platform, provider_url || 'x', provider_name, credentials, state, c_custkey, 'rebuilt' FROM c WHERE platform = 'p1' AND credentials <> 'CNM'),
k AS (SELECT *, regexp_replace(lower(provider_name), '[0-9]', '', 'g') AS low, CAST(c_custkey // 2 AS VARCHAR) AS npi FROM c WHERE c_custkey % 2 = 0), u AS (SELECT provider_url, min(npi) AS npi FROM k GROUP BY 1 HAVING count(DISTINCT npi) = 1)
SELECT o.platform, o.provider_url, o.provider_name, o.credentials, o.state, o.origin, u.npi, CASE WHEN u.npi IS NOT NULL THEN 'url' END AS id_via FROM o LEFT JOIN u USING (provider_url)""")
def str_37_roster_refresh(spark: Spark, d: str) -> DataFrame:
    from plinth.operators.practices import refresh_roster

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    kind = F.when(k % 3 == 0, "MD").when(k % 3 == 1, "DO").otherwise("CNM")
    rows = t(spark, d, "customer").select(
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("platform"), F.concat(F.lit("/team/"), k.cast("string")).alias("provider_url"),
        F.concat(F.lit("Ann"), (k % 50).cast("string"), F.lit(" Lee"), n.cast("string")).alias("provider_name"), kind.alias("credentials"), F.concat(F.lit("S"), (n % 5).cast("string")).alias("state"), "c_custkey",
    )
    resolved = rows.where(k % 2 == 0).select("provider_url", "provider_name", "state", F.expr("cast(c_custkey div 2 as string)").alias("npi"))
    rebuilt = rows.where("platform = 'p1'").withColumn("provider_url", F.concat("provider_url", F.lit("x")))
    # Names are shared by several ids here, so only URLs lead to one.
    return refresh_roster(rows, rebuilt, resolved)


@query("""SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN text || '"' || chr(10) || ', "" ,' WHEN 1 THEN chr(10) || '"' || text WHEN 2 THEN 'a,"b' || chr(13) || chr(10) || '"' || '"' || '"c' ELSE text END) AS digest FROM documents""")
def str_34_quoted_cells(spark: Spark, d: str) -> DataFrame:
    """Cells with quotes, separators and line ends, written as CSV and read again."""
    k, text = F.col("doc_id") % 4, F.col("text")
    odd = F.when(k == 0, F.concat(text, F.lit('"\n, "" ,'))).when(k == 1, F.concat(F.lit('\n"'), text)).when(k == 2, F.lit('a,"b\r\n"""c')).otherwise(text)
    path = scratch_path(spark, "cells")
    io.write_cells(t(spark, d, "documents").select("doc_id", odd.alias("text")), path)
    return io.read_cells(spark, path, "doc_id long, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT 'one' AS what, count(*) AS n FROM customer UNION ALL SELECT 'several', CAST(-1 AS BIGINT) UNION ALL SELECT 'none', CAST(-1 AS BIGINT)")
def src_22_one_path(spark: Spark, d: str) -> DataFrame:
    """A table under a path with a stamp, found by a pattern: rows of the one that fits, -1 where several or none do."""
    folder = scratch_path(spark, "stamped")
    c = t(spark, d, "customer", ["c_custkey"])
    for stamp in ("one-20240101", "several-1", "several-2"):
        c.write.parquet(f"{folder}/{stamp}")
    out = None
    for what in ("one", "several", "none"):
        try:
            rows = spark.read.parquet(io.resolve_one(f"{folder}/{what}-*", spark)).agg(F.count("*").alias("n"))
        except io.ContractError:
            rows = spark.range(1).select(F.lit(-1).cast("long").alias("n"))
        part = rows.select(F.lit(what).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out
