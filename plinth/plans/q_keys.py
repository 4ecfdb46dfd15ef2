"""Queries of sources, projections, filters, keys, text and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import dates, geo, keys, scalars, text
from plinth.operators import filters, reshape
from plinth.plans.registry import query
from plinth.sources import io
from plinth.sources.io import read_table as t

Spark = SparkSession


@query("SELECT c_custkey, c_name FROM customer")
def src_04_pruned_scan(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer", ["c_custkey", "c_name"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY','FURNITURE') THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def src_03_null_tokens(spark: Spark, d: str) -> DataFrame:
    return io.with_null_tokens(t(spark, d, "customer", ["c_custkey", "c_mktsegment"]), ("MACHINERY", "FURNITURE"), ["c_mktsegment"])


@query("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def src_20_not_done(spark: Spark, d: str) -> DataFrame:
    done = t(spark, d, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return io.not_done(t(spark, d, "orders", ["o_orderkey"]), done, ["o_orderkey"])


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_suppkey, s_name, s_nationkey, CAST(0 AS DOUBLE) FROM supplier WHERE s_nationkey = 3")
def snk_06_upsert(spark: Spark, d: str) -> DataFrame:
    old = t(spark, d, "supplier")
    return io.upsert(old, old.where("s_nationkey = 3").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])


@query("SELECT string_agg(n_nationkey || ', ' || n_name, ' | ' ORDER BY n_nationkey) AS choices FROM nation")
def snk_08_choice_list(spark: Spark, d: str) -> DataFrame:
    return io.choice_list(t(spark, d, "nation"), "n_nationkey", "n_name")


@query("SELECT c_custkey AS id, c_name AS display_name, c_nationkey AS nation FROM customer")
def prj_01_pick(spark: Spark, d: str) -> DataFrame:
    return reshape.pick(t(spark, d, "customer"), {"c_custkey": "id", "c_name": "display_name", "c_nationkey": "nation"})


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_tax > 0.04 AS is_taxed FROM lineitem")
def prj_02_derived(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), (F.col("l_tax") > 0.04).alias("is_taxed"))


@query("SELECT s_suppkey AS id, s_name AS name, 'N/A' AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def prj_04_align_and_stack(spark: Spark, d: str) -> DataFrame:
    s = reshape.pick(t(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "name"})
    c = reshape.pick(t(spark, d, "customer"), {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"})
    return reshape.align(s, ["id", "name", "segment"], "N/A").unionByName(c)


@query("SELECT CAST(2000 + row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS id, * FROM lineitem")
def prj_05_sequential_id(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]]
    return reshape.sequential_id(li, order, "id", 2001)


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY f) AS BIGINT) AS group_id FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part)")
def prj_06_dense_id(spark: Spark, d: str) -> DataFrame:
    return reshape.dense_id(t(spark, d, "part", ["p_partkey", "p_brand"]), F.col("p_brand"), ["p_partkey"]).select("p_partkey", "group_id")


@query("SELECT p_partkey, CASE WHEN p_name = '' THEN p_brand ELSE p_name || ', ' || p_brand END AS shown FROM part")
def prj_07_display_name(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", reshape.display_name([F.col("p_name"), F.col("p_brand")]).alias("shown"))


@query("SELECT o_orderkey, 'first' AS role, o_custkey AS id FROM orders UNION ALL SELECT o_orderkey, 'second', o_custkey + 100000 FROM orders")
def prj_09_arms_to_rows(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") + 100000).alias("b"))
    return reshape.arms_to_rows(o, ["o_orderkey"], {"a": "first", "b": "second"}, "role", "id")


@query("SELECT l_linenumber, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R, round(avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS difference FROM lineitem GROUP BY 1")
def prj_10_pivot_difference(spark: Spark, d: str) -> DataFrame:
    wide = reshape.pivot_difference(t(spark, d, "lineitem"), ["l_linenumber"], "l_returnflag", "l_quantity", "A", "R")
    return wide.select("l_linenumber", *[F.round(c, 6).alias(c) for c in ("A", "R", "difference")])


@query("SELECT n_nationkey, arm FROM nation, (VALUES ('medicaid'), ('commercial')) v(arm)")
def prj_11_cross_arms(spark: Spark, d: str) -> DataFrame:
    return reshape.cross_arms(t(spark, d, "nation", ["n_nationkey"]), ["medicaid", "commercial"])


@query("SELECT l_orderkey, l_linenumber, CAST(unnest(range(1, CAST(l_linenumber AS BIGINT) + 1)) AS INTEGER) AS copy FROM lineitem")
def prj_12_repeat_rows(spark: Spark, d: str) -> DataFrame:
    return reshape.repeat_rows(t(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]), F.col("l_linenumber").cast("int"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END, c_name) AS v FROM customer")
def prj_13_first_usable(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", keys.first_usable([F.col("c_mktsegment"), F.col("c_name")], ("MACHINERY",)).alias("v"))


@query("SELECT p_partkey, CAST(p_partkey AS INTEGER) AS ordinal, p_name AS name FROM part")
def prj_14_split_ordinal(spark: Spark, d: str) -> DataFrame:
    raw = F.concat(F.format_number("p_partkey", 0), F.lit(" | "), F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", reshape.split_ordinal(raw).alias("s")).select("p_partkey", "s.*")


@query("SELECT o_orderkey, CAST((o_orderkey + 1) // 2 AS BIGINT) AS pair, o_orderkey % 2 AS arm FROM orders")
def prj_16_pair_of_code(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", scalars.pair_of(F.col("o_orderkey")).alias("s")).select("o_orderkey", "s.*")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)ring|RED') OR regexp_matches(p_type, '(?i)ring|RED') OR regexp_matches(p_brand, '(?i)ring|RED')")
def flt_01_any_column(spark: Spark, d: str) -> DataFrame:
    p = t(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    return p.where(filters.any_column_matches(p, "ring|RED", ["p_name", "p_type", "p_brand"])).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE NOT contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'bolt')")
def flt_02_not_listed(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part", ["p_partkey", "p_name"]).where(filters.not_listed(F.col("p_name"), ["ring", "bolt"]))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|bolt') AND NOT regexp_matches(p_name, 'red') THEN p_size END AS ranked FROM part")
def flt_03_included_rank(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", filters.included_rank(F.col("p_name"), "ring|bolt", "red", F.col("p_size")).alias("ranked"))


@query("SELECT count(*) AS before, count(*) FILTER (c_mktsegment NOT IN ('MACHINERY')) AS after FROM customer")
def flt_04_membership_report(spark: Spark, d: str) -> DataFrame:
    return filters.membership(t(spark, d, "customer"), "c_mktsegment", ["MACHINERY"], keep=False)[1]


@query("SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) >= (SELECT max(year(o_orderdate)) - 4 FROM orders)")
def flt_07_recent(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"))
    return filters.recent(o, "y", 4)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def flt_10_whole_groups(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    return filters.whole_groups(li, ["l_orderkey"], F.col("l_returnflag") == "R", "none").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_quantity IS NOT NULL AND l_discount <> 0")
def flt_11_pushed_predicate(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity is not null and l_discount <> 0").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 're') AND length(p_name) < 10 AND NOT regexp_matches(p_name, 'bolt')")
def flt_12_line_shape(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part").where(filters.line_shape(F.col("p_name"), "re", 10, "bolt")).select("p_partkey")


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS npi, lpad(CAST(c_custkey AS VARCHAR), 10, '5') AS phone, CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 5) END AS zip FROM customer")
def str_01_02_08_keys(spark: Spark, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    messy_phone = F.concat(F.lit("1 ("), F.substring(F.lpad(k, 10, "5"), 1, 3), F.lit(") "), F.substring(F.lpad(k, 10, "5"), 4, 7))
    return t(spark, d, "customer").select("c_custkey", keys.npi_key(F.concat(F.lit(" "), k, F.lit(".0 "))).alias("npi"), keys.phone_key(messy_phone).alias("phone"), keys.zip5(F.concat(k, F.lit(".0"))).alias("zip"))


@query("SELECT c_custkey, substr(p, 1, 3) || '-' || substr(p, 4, 3) || '-' || substr(p, 7, 4) AS shown FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '5') AS p FROM customer)")
def str_03_phone_display(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", keys.phone_display(F.lpad(F.col("c_custkey").cast("string"), 10, "5")).alias("shown"))


@query(r"""SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') || '_NATION' || s_nationkey || '_CO_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS office FROM supplier""")
def str_04_address_key(spark: Spark, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    street = F.concat(F.col("s_name"), F.lit(", Suite "), F.col("s_suppkey").cast("string"))
    key = keys.address_key(street, F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")), F.lit("co"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"))
    return s.select("s_suppkey", key.alias("office"))


@query("SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code FROM nation")
def str_09_fips(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "nation").select("n_nationkey", keys.fips(F.col("n_nationkey"), 5).alias("code"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last, 'MD' AS credentials FROM part")
def str_10_parse_name(spark: Spark, d: str) -> DataFrame:
    n = keys.parse_name(F.concat(F.lit("Dr. "), F.col("p_name"), F.lit(", M.D.")))
    return t(spark, d, "part").select("p_partkey", n.alias("n")).select("p_partkey", "n.first", "n.last", "n.credentials")


@query("SELECT p_partkey, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS titled FROM part")
def str_19_title_case(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", keys.title_case(F.upper("p_name")).alias("titled"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') THEN 'cheap' WHEN contains(p_type, 'SMALL') THEN 'small' ELSE 'Unknown' END AS label FROM part")
def str_16_ordered_label(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", keys.ordered_label(F.col("p_type"), (("cheap", ("ECONOMY",)), ("small", ("SMALL",)))).alias("label"))


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title FROM pages")
def str_22_page_title(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"#?]+)', 1))) AS INTEGER) AS n_links FROM pages")
def str_23_links(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.size(text.links(F.col("html"), 1)).alias("n_links"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '([^/]+)$', 1), '[-_]+', ' ', 'g') AS slug FROM pages")
def str_22_slug(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), text.slug_label(F.col("url")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', l_quantity) AS one, printf('%.2f', l_discount) AS two FROM lineitem")
def str_28_fixed(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.fixed(F.col("l_quantity"), 1).alias("one"), text.fixed(F.col("l_discount"), 2).alias("two"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.z'), 'none') AS z FROM events")
def jsn_01_path(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", text.json_path(F.col("props"), "$.k").cast("int").alias("k"), text.json_path(F.col("props"), "$.z", "none").alias("z"))


@query("SELECT event_id, props AS segment FROM events")
def jsn_02_balanced_segment(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", text.balanced_segment(F.concat(F.lit("x = "), F.col("props"), F.lit("; y")), "x =").alias("segment"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def hsh_01_sha256(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_positive, len(list_filter(embedding, lambda x: x > 10)) > 0 AS has_large, round(CAST(coalesce(list_filter(embedding, lambda x: x > 0)[1], embedding[1]) AS DOUBLE), 5) AS picked FROM embeddings")
def arr_01_02_elements(spark: Spark, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    pick = scalars.first_where(F.col("embedding"), lambda x: x > 0)
    return e.select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"), F.exists("embedding", lambda x: x > 10).alias("has_large"), F.round(pick.cast("double"), 5).alias("picked"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' WHEN 'FURNITURE' THEN 'F' ELSE '?' END AS code FROM customer")
def map_01_lookup(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", scalars.lookup(F.col("c_mktsegment"), {"MACHINERY": "M", "FURNITURE": "F"}, "?").alias("code"))


_CALENDAR_SQL = """
WITH d AS (SELECT CAST(g AS DATE) AS day FROM generate_series(DATE '1995-01-01', DATE '2003-12-31', INTERVAL 1 DAY) s(g)),
y AS (SELECT range AS y FROM range(1995, 2005)),
fixed AS (SELECT make_date(CAST(y AS INTEGER), m, dd) AS h FROM y, (VALUES (1,1),(6,19),(7,4),(11,11),(12,25)) v(m, dd)),
observed AS (SELECT CASE dayofweek(h) WHEN 6 THEN CAST(h - INTERVAL 1 DAY AS DATE) WHEN 0 THEN CAST(h + INTERVAL 1 DAY AS DATE) ELSE h END AS h FROM fixed),
moving AS (
  SELECT day AS h FROM d WHERE (month(day) = 1 AND dayofweek(day) = 1 AND day(day) BETWEEN 15 AND 21) OR (month(day) = 2 AND dayofweek(day) = 1 AND day(day) BETWEEN 15 AND 21)
  OR (month(day) = 5 AND dayofweek(day) = 1 AND day(day) BETWEEN 25 AND 31) OR (month(day) = 9 AND dayofweek(day) = 1 AND day(day) BETWEEN 1 AND 7)
  OR (month(day) = 10 AND dayofweek(day) = 1 AND day(day) BETWEEN 8 AND 14) OR (month(day) = 11 AND dayofweek(day) = 4 AND day(day) BETWEEN 22 AND 28)),
h AS (SELECT h FROM observed UNION SELECT h FROM moving),
c AS (SELECT day, sum(CASE WHEN dayofweek(day) IN (0, 6) OR day IN (SELECT h FROM h) THEN 0 ELSE 1 END) OVER (ORDER BY day) AS i FROM d)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) THEN b.i - a.i END AS INTEGER) AS business_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN c a ON a.day = CAST(o_orderdate AS DATE) LEFT JOIN c b ON b.day = CAST(l_shipdate AS DATE)
"""


@query(_CALENDAR_SQL)
def dat_01_business_days(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"])
    o = t(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")
    return dates.add_business_days(rows, "o_orderdate", "l_shipdate", calendar=dates.business_calendar(spark, 1995, 2003)).select("l_orderkey", "l_linenumber", "business_days")


@query("SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS days FROM orders")
def dat_02_calendar_days(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", dates.calendar_days(F.col("o_orderdate"), F.lit("2002-01-01")).alias("days"))


@query("SELECT o_orderkey, CAST(2002 - year(o_orderdate) AS INTEGER) AS years FROM orders")
def dat_03_years(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", dates.years_in_practice(F.lit(None).cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), 2002).alias("years"))


_POINT = "CAST(25 + (({k} * 7919) % 2400) / 100.0 AS DOUBLE) AS lat, CAST(-124 + (({k} * 104729) % 5700) / 100.0 AS DOUBLE) AS lon"
_MILES = "2 * 3959.0 * atan2(sqrt(h), sqrt(greatest(1 - h, 0)))"


def _points(df: DataFrame, k: str, name: str) -> DataFrame:
    return df.select(F.col(k).alias(name), (25 + ((F.col(k) * 7919) % 2400) / 100.0).alias("lat"), (-124 + ((F.col(k) * 104729) % 5700) / 100.0).alias("lon"))


@query(f"""WITH s AS (SELECT s_suppkey AS id, {_POINT.format(k='s_suppkey')} FROM supplier), c AS (SELECT c_custkey AS id, {_POINT.format(k='c_custkey')} FROM customer),
p AS (SELECT s.id AS left_id, c.id AS right_id, pow(sin(radians(c.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - s.lon) / 2), 2) AS h FROM s, c)
SELECT left_id, right_id, round({_MILES}, 4) AS miles FROM p WHERE {_MILES} <= 60""")
def joi_12_within_miles(spark: Spark, d: str) -> DataFrame:
    pairs = geo.within_miles(_points(t(spark, d, "supplier"), "s_suppkey", "id"), _points(t(spark, d, "customer"), "c_custkey", "id"), 60.0, digits=4)
    return pairs.select("left_id", "right_id", "miles")


@query("SELECT o_orderkey, round(ln(p / (1 - p)), 6) AS logit, least(greatest(o_totalprice, 1000), 50000) AS clamped, o_totalprice / 60 AS minutes FROM (SELECT *, (1 + o_orderkey % 97) / 100.0 AS p FROM orders)")
def mat_06_08_scalars(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    p = (1 + F.col("o_orderkey") % 97) / 100.0
    return o.select("o_orderkey", F.round(scalars.logit(p), 6).alias("logit"), scalars.clamp(F.col("o_totalprice"), 1000.0, 50000.0).alias("clamped"), (F.col("o_totalprice") / 60).alias("minutes"))
