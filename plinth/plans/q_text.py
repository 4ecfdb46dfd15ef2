"""Queries of the remaining key, text, array and number functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import geo, keys, scalars, text
from plinth.operators import drift, filters, gates, joins, reshape, windows
from plinth.plans.registry import query
from plinth.sources.io import read_table as t

Spark = SparkSession


@query("SELECT s_suppkey, s_suppkey || ' OAK ST | DENVER | CO | ' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS office FROM supplier")
def str_05_office_key(spark: Spark, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    office = keys.office_key(F.concat(k, F.lit(" Oak Street, Suite 7 rear")), F.lit("Denver"), F.lit("co"), k, F.lit("none"))
    return t(spark, d, "supplier").select("s_suppkey", office.alias("office"))


@query("SELECT s_suppkey, s_suppkey || ' OAK AVE' AS street FROM supplier")
def str_07_strip_suite(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "supplier").select("s_suppkey", keys.strip_suite(F.concat(F.col("s_suppkey").cast("string"), F.lit(" Oak Ave #Apt 12B"))).alias("street"))


@query("SELECT p_partkey, p_name AS name_key FROM part WHERE contains(p_name, ' ')")
def str_11_first_last_key(spark: Spark, d: str) -> DataFrame:
    n = keys.first_last_key(F.concat(F.upper("p_name"), F.lit(".")))
    return t(spark, d, "part").select("p_partkey", n.alias("name_key")).where("name_key is not null")


@query("SELECT p_partkey, replace(upper(p_name), ' ', '|') AS tokens FROM part")
def str_12_board_tokens(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.array_join(keys.board_tokens(F.concat("p_name", F.lit(" M.D. x"))), "|").alias("tokens"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'physician' WHEN c_custkey % 3 = 1 THEN 'mid_level' END AS kind FROM customer")
def str_13_credential_kind(spark: Spark, d: str) -> DataFrame:
    c = F.when(F.col("c_custkey") % 3 == 0, "M.D., FACOG").when(F.col("c_custkey") % 3 == 1, "CNM").otherwise("Esq.")
    return t(spark, d, "customer").select("c_custkey", keys.credential_kind(c).alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'DO' WHEN c_custkey % 3 = 1 THEN 'MD' WHEN c_custkey % 2 = 0 THEN 'MD' END AS degree FROM customer")
def str_15_md_or_do(spark: Spark, d: str) -> DataFrame:
    c = F.when(F.col("c_custkey") % 3 == 0, "D.O., MD").when(F.col("c_custkey") % 3 == 1, "M.D.").otherwise("none")
    return t(spark, d, "customer").select("c_custkey", keys.md_or_do(c, F.col("c_name"), identified=F.col("c_custkey") % 2 == 0).alias("degree"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'IMG' ELSE 'US/Canada' END AS origin FROM customer")
def str_17_school_origin(spark: Spark, d: str) -> DataFrame:
    school = F.when(F.col("c_custkey") % 2 == 0, "Universidad de Guadalajara, Mexico").otherwise("State College")
    return t(spark, d, "customer").select("c_custkey", keys.school_origin(school).alias("origin"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Generalist' WHEN 1 THEN 'Gynecologic Oncology' WHEN 2 THEN 'Not OB-GYN' ELSE 'Unknown' END AS label FROM part")
def str_18_taxonomy(spark: Spark, d: str) -> DataFrame:
    r = F.col("p_partkey") % 4
    code = F.when(r == 0, "207V00000X").when(r == 1, "207vx0201x ").when(r == 2, "208D00000X")
    return t(spark, d, "part").select("p_partkey", keys.taxonomy_subspecialty(code).alias("label"))


@query(r"SELECT page_id, CAST(length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s', '', 'g')) AS INTEGER) AS n_visible FROM pages")
def str_20_strip_tags(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.length(F.regexp_replace(text.strip_tags(F.col("html")), r"\s", "")).alias("n_visible"))


@query("SELECT s_suppkey, 'CO' AS state, 'Nation ' || s_nationkey AS city FROM supplier")
def str_21_state_and_city(spark: Spark, d: str) -> DataFrame:
    a = F.concat(F.lit("9 Elm St, Nation "), F.col("s_nationkey").cast("string"), F.lit(", CO 80202"))
    return t(spark, d, "supplier").select("s_suppkey", text.state_in(a).alias("state"), text.city_in(a).alias("city"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}.{0,10}'), '|') AS found FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def str_24_mentions(spark: Spark, d: str) -> DataFrame:
    m = F.regexp_extract_all("text", F.lit(r"([0-9]{3}-[0-9]{4}.{0,10})"), F.lit(1))
    return t(spark, d, "documents").where(F.col("text").rlike(r"[0-9]{3}-[0-9]{4}")).select("doc_id", F.array_join(m, "|").alias("found"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS code, c_name AS name, 'CO' AS state FROM customer")
def str_25_parse_choice(spark: Spark, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    line = F.concat(k, F.lit(", id: "), k, F.lit(", "), "c_name", F.lit(", Denver, CO, Phone: 303-555-0100"))
    return t(spark, d, "customer").select("c_custkey", text.parse_choice(line).alias("p")).select("c_custkey", "p.code", "p.name", "p.state")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def str_27_squash(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2(text.squash(F.col("text")), 256).alias("digest"))


@query("SELECT p_partkey, 'part:' || p_partkey || '|brand' || p_size AS cited FROM part")
def str_30_citation_keys(spark: Spark, d: str) -> DataFrame:
    prose = F.concat(F.lit("see [@part:"), F.col("p_partkey").cast("string"), F.lit("; @brand"), F.col("p_size").cast("string"), F.lit("] and a@b.org"))
    return t(spark, d, "part").select("p_partkey", F.array_join(text.citation_keys(prose), "|").alias("cited"))


@query("SELECT b.item_id AS claim_id, bool_or(contains(d.text, b.text)) AS is_found FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40 GROUP BY 1")
def str_31_located_claims(spark: Spark, d: str) -> DataFrame:
    claims = t(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), (F.col("item_id") % 40).alias("artifact"), F.col("text").alias("match_string"))
    sources = t(spark, d, "documents").select((F.col("doc_id") % 40).alias("artifact"), "text")
    return drift.located_claims(claims, sources)


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS odds FROM customer")
def str_32_scales(spark: Spark, d: str) -> DataFrame:
    m = text.scales(F.concat(F.lit("odds ["), F.col("c_custkey").cast("string"), F.lit("] rate [1]")))
    return t(spark, d, "customer").select("c_custkey", m["odds"].alias("odds"))


@query("SELECT s_suppkey, '9 Elm, Floor 2' AS street, 'N' || s_nationkey AS city, 'CO' AS state, '80202' AS zip FROM supplier")
def str_35_locality(spark: Spark, d: str) -> DataFrame:
    a = F.concat(F.lit("9 Elm<br>Floor 2<br/>N"), F.col("s_nationkey").cast("string"), F.lit(", CO 80202"))
    return t(spark, d, "supplier").select("s_suppkey", text.locality(a).alias("a")).select("s_suppkey", "a.*")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, (CASE WHEN o_totalprice > 200000 THEN 2 ELSE 0 END) + (CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 0 END) AS score FROM orders WHERE o_orderpriority <> '5-LOW'),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS r FROM h)
SELECT o_custkey, o_orderkey AS hit, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' WHEN score >= 2 THEN 'low' ELSE 'none' END AS quality FROM b WHERE r = 1""")
def str_14_match_quality(spark: Spark, d: str) -> DataFrame:
    hits = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))).alias("h"))
    score = lambda x: F.when(x["o_totalprice"] > 200000, 2).otherwise(0) + F.when(x["o_orderstatus"] == "O", 3).otherwise(0)
    best = hits.select("o_custkey", joins.best_hit(hits, "h", score, lambda x: x["o_orderpriority"] != "5-LOW").alias("b")).where("b is not null")
    s = score(F.col("b"))
    return best.select("o_custkey", F.col("b.o_orderkey").alias("hit"), F.when(s >= 5, "high").when(s >= 3, "medium").when(s >= 2, "low").otherwise("none").alias("quality"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct([c_nationkey % 3, c_nationkey % 5, c_nationkey % 7])), '|') AS states FROM customer")
def arr_03_union(spark: Spark, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    return t(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_union(F.array(n % 3), F.array(n % 5, n % 7))), "|").alias("states"))


@query("SELECT c_custkey, list_has_any([c_nationkey % 3, 9], [c_nationkey % 5, 8]) AS overlaps, CAST(len(list_distinct([c_nationkey % 3, c_nationkey % 5])) AS INTEGER) AS n_distinct FROM customer")
def arr_05_06_07_sets(spark: Spark, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    return t(spark, d, "customer").select("c_custkey", F.arrays_overlap(F.array(n % 3, F.lit(9)), F.array(n % 5, F.lit(8))).alias("overlaps"), F.size(F.array_distinct(F.array(n % 3, n % 5))).alias("n_distinct"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS geoid FROM customer")
def jsn_03_geoid(spark: Spark, d: str) -> DataFrame:
    j = F.concat(F.lit('{"result": {"GEOID": "'), F.lpad(F.col("c_custkey").cast("string"), 11, "0"), F.lit('"}}'))
    return t(spark, d, "customer").select("c_custkey", text.geoid_in(j).alias("geoid"))


_LAT, _LON = "(25 + ({k} * 7919) % 2400 / 100.0)", "(-124 + ({k} * 104729) % 5700 / 100.0)"


def _lat(k: str):
    return 25 + ((F.col(k) * 7919) % 2400) / 100.0


def _lon(k: str):
    return -124 + ((F.col(k) * 104729) % 5700) / 100.0


@query(f"""WITH x AS (SELECT s_suppkey, pow(sin(radians(40 - {_LAT.format(k='s_suppkey')}) / 2), 2) + cos(radians({_LAT.format(k='s_suppkey')})) * cos(radians(40)) * pow(sin(radians(-105 - {_LON.format(k='s_suppkey')}) / 2), 2) AS h FROM supplier)
SELECT s_suppkey, round(2 * 3959.0 * atan2(sqrt(h), sqrt(1 - h)), 4) AS miles FROM x""")
def mat_01_05_distance_to_point(spark: Spark, d: str) -> DataFrame:
    m = geo.haversine_miles(_lat("s_suppkey"), _lon("s_suppkey"), F.lit(40.0), F.lit(-105.0))
    return t(spark, d, "supplier").select("s_suppkey", F.round(m, 4).alias("miles"))


@query(f"SELECT s_suppkey, {_LAT.format(k='s_suppkey')} BETWEEN 37 AND 41 AND {_LON.format(k='s_suppkey')} BETWEEN -109 AND -102 AS is_inside FROM supplier")
def mat_03_in_box(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "supplier").select("s_suppkey", geo.in_box(_lat("s_suppkey"), _lon("s_suppkey"), F.lit(37), F.lit(41), F.lit(-109), F.lit(-102)).alias("is_inside"))


@query(f"""WITH c AS (SELECT c_custkey, {_LAT.format(k='c_custkey')} AS la, {_LON.format(k='c_custkey')} AS lo FROM customer), s AS (SELECT s_suppkey, {_LAT.format(k='s_suppkey')} AS la, {_LON.format(k='s_suppkey')} AS lo FROM supplier),
p AS (SELECT s_suppkey, pow(sin(radians(c.la - s.la) / 2), 2) + cos(radians(s.la)) * cos(radians(c.la)) * pow(sin(radians(c.lo - s.lo) / 2), 2) AS h FROM s, c)
SELECT s_suppkey, count(*) FILTER (2 * 3959.0 * atan2(sqrt(h), sqrt(1 - h)) <= 15) AS n_near FROM p GROUP BY 1""")
def mat_04_count_within_miles(spark: Spark, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select("s_suppkey", _lat("s_suppkey").alias("lat"), _lon("s_suppkey").alias("lon"))
    c = t(spark, d, "customer").select("c_custkey", _lat("c_custkey").alias("lat"), _lon("c_custkey").alias("lon"))
    return geo.count_within_miles(s, c, "s_suppkey", 15.0).withColumnRenamed("n", "n_near")


@query("SELECT p_partkey, round(exp(x), 6) AS estimate, round(exp(x - 1.959963984540054 * 0.1), 6) AS low, round(exp(x + 1.959963984540054 * 0.1), 6) AS high FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)")
def mat_07_wald_interval(spark: Spark, d: str) -> DataFrame:
    w = scalars.wald_interval(F.col("p_size") / 50.0, F.lit(0.1))
    return t(spark, d, "part").select("p_partkey", w.alias("w")).select("p_partkey", *[F.round(f"w.{c}", 6).alias(c) for c in ("estimate", "low", "high")])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_size <= 30 THEN p_size ELSE 31 END AS days FROM part")
def mat_09_censored(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", scalars.censored(F.col("p_size"), F.col("p_partkey") % 3 != 0, 30).alias("days"))


@query("SELECT o_orderkey, round(o_totalprice, 0) AS half_up FROM orders")
def mat_11_round(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 0).alias("half_up"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE coalesce(n_name, '') END AS place FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def joi_22_fill_where_blank(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumn("place", F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise("N/A"))
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.fill_where_blank(c, n, "c_nationkey", "place", "n_name").select("c_custkey", F.coalesce("place", F.lit("")).alias("place"))


@query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)")
def joi_23_pushed_semi(spark: Spark, d: str) -> DataFrame:
    rich = t(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.safe_join(t(spark, d, "lineitem", ["l_orderkey", "l_suppkey"]), rich, ["l_suppkey"], "left_semi").select("l_orderkey", "l_suppkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p = o_orderstatus")
def win_06_adjacent_equal(spark: Spark, d: str) -> DataFrame:
    return filters.adjacent_equal(t(spark, d, "orders"), ["o_orderkey"], "o_orderstatus", ["o_custkey"]).select("o_orderkey")


@query("SELECT o_orderkey, coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 99) AS rank FROM orders")
def srt_01_custom_order(spark: Spark, d: str) -> DataFrame:
    at = windows.custom_order(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return t(spark, d, "orders").select("o_orderkey", F.coalesce(at.cast("int"), F.lit(99)).alias("rank"))


@query("SELECT n_name AS SIMULATED_n_name, n_nationkey FROM nation")
def prj_15_mark_untrusted(spark: Spark, d: str) -> DataFrame:
    return reshape.mark_untrusted(t(spark, d, "nation", ["n_nationkey", "n_name"]), ["n_name"])


@query("SELECT 'open' AS series, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'filled', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def prj_17_stack(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return reshape.stack({"open": o.where("o_orderstatus = 'O'"), "filled": o.where("o_orderstatus = 'F'")}, "series", ["o_orderkey", "o_totalprice"])


@query("SELECT 'non_empty' AS rule, 'v' AS detail, count(*) AS n FROM customer WHERE c_custkey % 5 = 0")
def row_03_non_empty(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_name")).alias("v"))
    return gates.rule_non_empty(c, ["v"])[0]


@query("SELECT 'differ' AS rule, 'a <> b' AS detail, count(*) AS n FROM customer WHERE c_nationkey = c_custkey % 25")
def row_08_differ(spark: Spark, d: str) -> DataFrame:
    return gates.rule_differ(t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b")), "a", "b")


@query("SELECT round(count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) / count(*), 6) AS coverage FROM orders")
def gate_05_coverage(spark: Spark, d: str) -> DataFrame:
    rate = gates.coverage_gate(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", 0.5)
    return spark.createDataFrame([(round(rate, 6),)], "coverage double")
