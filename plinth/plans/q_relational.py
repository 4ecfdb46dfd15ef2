"""Queries of joins, aggregates, windows, ordering and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import aggs, calipers, joins, reshape, select, windows
from plinth.plans.registry import query
from plinth.sources.io import read_table as t

Spark = SparkSession


# joins -----------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def joi_01_left_unique(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.safe_join(t(spark, d, "orders", ["o_orderkey", "o_custkey"]), c, ["o_custkey"]).select("o_orderkey", "c_name")


@query("SELECT l.l_orderkey, l.l_linenumber, s.low FROM lineitem l LEFT JOIN (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS low FROM lineitem GROUP BY ALL) s USING (l_partkey, l_suppkey)")
def joi_02_left_composite(spark: Spark, d: str) -> DataFrame:
    li = joins.dealt(t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])
    low = li.groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("low"))
    return joins.safe_join(li, low, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "low")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def joi_03_inner(spark: Spark, d: str) -> DataFrame:
    s, n, r = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_suppliers, coalesce(b.n, 0) AS n_customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.k = b.k")
def joi_04_full(spark: Spark, d: str) -> DataFrame:
    a = t(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = t(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("n_suppliers"), F.coalesce("b", F.lit(0)).alias("n_customers"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def joi_05_semi(spark: Spark, d: str) -> DataFrame:
    big = t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.safe_join(t(spark, d, "customer", ["c_custkey"]), big, ["c_custkey"], "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def joi_06_anti(spark: Spark, d: str) -> DataFrame:
    big = t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.safe_join(t(spark, d, "customer", ["c_custkey"]), big, ["c_custkey"], "left_anti")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def joi_07_lookup(spark: Spark, d: str) -> DataFrame:
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup_join(t(spark, d, "customer"), n, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("SELECT n_nationkey, c_custkey, c_name FROM nation LEFT JOIN (SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r = 1) ON n_nationkey = c_nationkey")
def joi_08_first_match(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return joins.first_match(t(spark, d, "nation", ["n_nationkey"]), c, ["n_nationkey"], ["c_acctbal", "c_custkey"], ["c_custkey", "c_name"])


@query("""SELECT c.c_custkey, coalesce(a.v, b.v, 'none') AS v, CASE WHEN a.v IS NOT NULL THEN 'segment' WHEN b.v IS NOT NULL THEN 'nation' ELSE 'rule' END AS match_via FROM customer c
LEFT JOIN (SELECT c_nationkey, c_mktsegment, 's' || min(c_custkey) AS v FROM customer WHERE c_acctbal > 8000 GROUP BY ALL) a USING (c_nationkey, c_mktsegment)
LEFT JOIN (SELECT s_nationkey, 'n' || min(s_suppkey) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) b ON c.c_nationkey = b.s_nationkey""")
def joi_09_cascade(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    a = c.where("c_acctbal > 8000").groupBy("c_nationkey", "c_mktsegment").agg(F.concat(F.lit("s"), F.min("c_custkey").cast("string")).alias("v"))
    b = t(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.concat(F.lit("n"), F.min("s_suppkey").cast("string")).alias("v"))
    return joins.cascade(c, [("segment", a, ["c_nationkey", "c_mktsegment"]), ("nation", b, ["c_nationkey"])], "v", "none").select("c_custkey", "v", "match_via")


@query("""SELECT c_custkey, CASE WHEN n = 1 THEN v END AS s_suppkey, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM customer
LEFT JOIN (SELECT s_nationkey AS c_nationkey, floor(s_acctbal / 2500) AS b, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS v FROM supplier GROUP BY ALL) s ON customer.c_nationkey = s.c_nationkey AND floor(c_acctbal / 2500) = s.b""")
def joi_10_unique_or_ambiguous(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumns({"n": F.col("c_nationkey"), "b": F.floor(F.col("c_acctbal") / 2500)})
    s = t(spark, d, "supplier").withColumns({"n": F.col("s_nationkey"), "b": F.floor(F.col("s_acctbal") / 2500)})
    return joins.unique_or_ambiguous(c, s, ["n", "b"], "s_suppkey").select("c_custkey", "s_suppkey", "status")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def joi_11_keyed_join(spark: Spark, d: str) -> DataFrame:
    from plinth.functions.keys import npi_key

    o = t(spark, d, "orders").withColumn("k", F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    return joins.keyed_join(o, t(spark, d, "customer"), "k", "c_custkey", npi_key, ["c_name"], ["c_custkey"], 0.5).select("o_orderkey", "c_name")


@query("""WITH p AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS r FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT s_suppkey, c_custkey, round(gap, 2) AS gap FROM p WHERE r = 1""")
def joi_14_best_candidate(spark: Spark, d: str) -> DataFrame:
    s, c = (t(spark, d, name).withColumnRenamed(f"{name[0]}_nationkey", "nation") for name in ("supplier", "customer"))
    best = joins.best_by_gap(s, c, ["nation"], "s_suppkey", "s_acctbal", "c_custkey", "c_acctbal")
    return best.select("s_suppkey", "c_custkey", F.round("gap", 2).alias("gap"))


@query("SELECT DISTINCT a.s_suppkey AS left_id, b.s_suppkey AS right_id FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND (floor(a.s_acctbal / 100) = floor(b.s_acctbal / 100) OR (a.s_nationkey = b.s_nationkey AND a.s_suppkey % 3 = b.s_suppkey % 3))")
def joi_15_either_key(spark: Spark, d: str) -> DataFrame:
    s = t(spark, d, "supplier").withColumns({"bucket": F.floor(F.col("s_acctbal") / 100), "third": F.col("s_suppkey") % 3})
    return joins.either_key(s, s, [["bucket"], ["s_nationkey", "third"]], "s_suppkey", "s_suppkey").where("left_id <> right_id")


@query("SELECT a.o_orderkey // 2 AS pair, a.o_totalprice AS o_totalprice_1, b.o_totalprice AS o_totalprice_2 FROM orders a JOIN orders b ON a.o_orderkey // 2 = b.o_orderkey // 2 WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1")
def joi_16_pair_members(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.expr("o_orderkey div 2").alias("pair"), F.when(F.col("o_orderkey") % 2 == 0, "PE").otherwise("Non-PE").alias("arm"), "o_totalprice")
    return joins.pair_members(o, "pair", "arm", "PE", "Non-PE", ["o_totalprice"])


@query("""WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 0 END + CASE WHEN o_totalprice > 300000 THEN 2 ELSE 0 END DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey, o_orderkey AS best FROM h WHERE r = 1""")
def joi_18_best_hit(spark: Spark, d: str) -> DataFrame:
    hits = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))).alias("hits"))
    score = lambda x: F.when(x["o_orderstatus"] == "O", 3).otherwise(0) + F.when(x["o_totalprice"] > 300000, 2).otherwise(0)
    best = joins.best_hit(hits, "hits", score, lambda x: x["o_orderstatus"] != "P")
    return hits.select("o_custkey", best["o_orderkey"].alias("best")).where("best is not null")


@query("SELECT c_custkey AS k, 'customers' AS only_in FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def joi_19_key_agreement(spark: Spark, d: str) -> DataFrame:
    c, o = t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return joins.key_agreement(c, o, ["k"], ("customers", "orders"))


@query("SELECT s.s_suppkey AS k FROM supplier s JOIN customer c ON s.s_suppkey = c.c_custkey WHERE s.s_nationkey <> c.c_nationkey")
def joi_20_disagreements(spark: Spark, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return joins.disagreements(s, c, ["k"], {"s_nationkey": "c_nationkey"}).select("k")


@query("SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'tract' WHEN b.v IS NOT NULL THEN 'zcta' END AS method FROM customer LEFT JOIN (SELECT s_suppkey, s_acctbal AS v FROM supplier) a ON c_custkey = s_suppkey LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) b ON c_nationkey = s_nationkey")
def joi_21_fallback(spark: Spark, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("v"))
    b = s.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("v"))
    return joins.with_fallback(t(spark, d, "customer"), a, b, "c_custkey", "c_nationkey", "v", ("tract", "zcta")).select("c_custkey", "v", "method")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS u, c_custkey AS c, abs(s_acctbal - c_acctbal) AS w FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) < 1500),
a AS (SELECT u, row_number() OVER (ORDER BY u) AS i FROM e GROUP BY u HAVING count(*) >= 2),
p AS (SELECT i, list(struct_pack(w := w, c := c) ORDER BY w, c) AS l FROM e JOIN a USING (u) GROUP BY i),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken UNION ALL SELECT p.i, list_append(r.taken, coalesce(list_filter(p.l, lambda x: NOT list_contains(r.taken, x.c))[1].c, -1)) FROM r JOIN p ON p.i = r.i + 1)
SELECT e.u AS s_suppkey, e.c AS c_custkey, round(e.w, 4) AS gap FROM r JOIN a USING (i) JOIN e ON e.u = a.u AND e.c = r.taken[len(r.taken)]""")
def joi_13_greedy_match(spark: Spark, d: str) -> DataFrame:
    s, c = t(spark, d, "supplier").withColumn("o", F.col("s_suppkey")), t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("s_nationkey"))
    got = calipers.greedy_caliper_match(s, c, ["s_nationkey"], "s_suppkey", "s_acctbal", "o", "c_custkey", "c_acctbal", 1500.0, 2)
    return got.withColumn("gap", F.round("gap", 4))


@query("""WITH RECURSIVE e AS (SELECT l_suppkey * 100000 + l_linenumber * 10000 + l_partkey AS u, p_partkey AS c, abs(l_partkey - p_partkey) AS w, l_orderkey AS o FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem QUALIFY i = 1) JOIN part ON p_size % 10 = l_suppkey % 10 AND abs(l_partkey - p_partkey) < 40),
a AS (SELECT u, row_number() OVER (ORDER BY o, u) AS i FROM (SELECT u, min(o) AS o FROM e GROUP BY u HAVING count(*) >= 2)),
p AS (SELECT i, list(struct_pack(w := w, c := c) ORDER BY w, c) AS l FROM e JOIN a USING (u) GROUP BY i),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken UNION ALL SELECT p.i, list_append(r.taken, coalesce(list_filter(p.l, lambda x: NOT list_contains(r.taken, x.c))[1].c, -1)) FROM r JOIN p ON p.i = r.i + 1)
SELECT e.u, e.c, CAST(e.w AS DOUBLE) AS gap FROM r JOIN a USING (i) JOIN e ON e.u = a.u AND e.c = r.taken[len(r.taken)]""")
def joi_13_first_lines(spark: Spark, d: str) -> DataFrame:
    """Each supplier's first line takes the nearest free part of its class by number, in order of orders."""
    li = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    first = joins.keep_first(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])
    u = first.select((F.col("l_suppkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("u"), (F.col("l_suppkey") % 10).alias("k"), F.col("l_partkey").alias("s"), F.col("l_orderkey").alias("o"))
    c = t(spark, d, "part").select(F.col("p_partkey").alias("c"), (F.col("p_size") % 10).alias("k"), F.col("p_partkey").alias("v"))
    return calipers.greedy_caliper_match(u, c, ["k"], "u", "s", "o", "c", "v", 40.0, 2)


@query("""WITH RECURSIVE o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 977)) AS ks, max(o_totalprice) AS top FROM orders GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY -top, o_custkey) AS i FROM o),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, 0 AS n, false AS sel UNION ALL
  SELECT n.i, CASE WHEN list_has_any(r.used, n.ks) THEN r.used ELSE list_concat(r.used, n.ks) END, r.n + CASE WHEN list_has_any(r.used, n.ks) THEN 0 ELSE 1 END, NOT list_has_any(r.used, n.ks) FROM r JOIN n ON n.i = r.i + 1 WHERE r.n < 40),
s AS (SELECT n.* FROM r JOIN n USING (i) WHERE r.sel), m AS (SELECT count(*) AS k, max(i) AS last FROM s),
h AS (SELECT i AS hi, o_custkey AS holder, unnest(ks) AS k FROM s),
x AS (SELECT d.o_custkey, arg_min(h.holder, k) AS holder FROM (SELECT o_custkey, i, unnest(ks) AS k FROM n) d JOIN h USING (k) WHERE h.hi < d.i GROUP BY 1),
f AS (SELECT n.o_custkey, x.holder, CASE WHEN n.i IN (SELECT i FROM s) THEN 'selected' WHEN m.k >= 40 AND n.i > m.last THEN 'not_needed' ELSE 'dropped_shares_key' END AS status FROM n CROSS JOIN m LEFT JOIN x USING (o_custkey))
SELECT o_custkey, status, CASE WHEN status = 'dropped_shares_key' THEN CAST(holder AS VARCHAR) END AS conflicts_with, false AS self_collision FROM f""")
def srt_07_disjoint_selection(spark: Spark, d: str) -> DataFrame:
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.col("o_orderkey") % 977)), lambda x: x.cast("string"))).alias("keys"), F.max("o_totalprice").alias("top"))
    return select.disjoint_selection(o.withColumn("rank", -F.col("top")), "o_custkey", "keys", ["rank"], 40)


@query("""WITH a AS (SELECT salt, s_suppkey AS pair, row_number() OVER (PARTITION BY salt ORDER BY md5('7|' || salt || '|' || s_suppkey), s_suppkey) AS i FROM supplier, range(0, 120) r(salt)),
b AS (SELECT salt, pair, arm, (i % 2 = 1) = (arm = 'Non-PE') AS odd FROM a, (VALUES ('PE'), ('Non-PE')) v(arm)),
c AS (SELECT *, 2 * (row_number() OVER (PARTITION BY salt, odd ORDER BY md5('7|' || salt || '|' || odd::INT || '|' || pair), pair) - 1) + CASE WHEN odd THEN 1 ELSE 2 END AS slot FROM b),
g AS (SELECT salt FROM (SELECT salt, pair, max(slot) - min(slot) AS gap FROM c GROUP BY ALL) GROUP BY 1 HAVING min(gap) > 1)
SELECT pair, arm, CAST(slot AS BIGINT) AS slot FROM c WHERE salt = (SELECT min(salt) FROM g)""")
def srt_08_blinded_slots(spark: Spark, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("pair"))
    return select.blinded_slots(reshape.cross_arms(s, ["PE", "Non-PE"]), "pair", "arm", 7)


# aggregates --------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean_price, round(100 * avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END), 6) AS pct FROM lineitem GROUP BY ALL", name="agg_grouped_summary")
def agg_01_grouped_summary(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(100 * F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("pct"))


@query("SELECT c_mktsegment, count(*) AS n, count(c_acctbal) AS n_valid, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(median(c_acctbal), 4) AS median, min(c_acctbal) AS lowest, max(c_acctbal) AS highest FROM customer GROUP BY 1")
def agg_02_28_summary(spark: Spark, d: str) -> DataFrame:
    s = aggs.summary(t(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")
    return s.select("c_mktsegment", "n", "n_valid", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "median")], "lowest", "highest")


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_segments, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS segments FROM customer WHERE c_acctbal > 7000 GROUP BY 1")
def agg_04_07_distinct(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").where("c_acctbal > 7000").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("n_segments"), aggs.sorted_distinct("c_mktsegment").alias("segments"))


@query("""SELECT p_brand, count(*) AS n_source_rows, min(p_size) AS org_size_min, max(p_size) AS org_size_max, count(DISTINCT p_size) AS n_distinct_org, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS facilities,
min(p_size) <= 10 AND 10 < max(p_size) AS ambiguous, CASE WHEN NOT (min(p_size) <= 10 AND 10 < max(p_size)) THEN min(p_size) > 10 END AS is_large FROM part GROUP BY 1""")
def agg_08_org_classification(spark: Spark, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("p_size", F.col("p_size").cast("string"))
    return aggs.org_classification(p, "p_brand", "p_size", "p_type", 10)


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def agg_09_weighted_mean(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(aggs.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("weighted"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def agg_10_arg_max(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy("o_custkey").agg(aggs.arg_max(["o_orderkey", "o_totalprice"], ["o_totalprice", "o_orderkey"]).alias("b")).select("o_custkey", "b.*")


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 6) AS rate_open FROM orders GROUP BY 1")
def agg_11_rates(spark: Spark, d: str) -> DataFrame:
    r = aggs.rates(t(spark, d, "orders"), ["o_orderpriority"], {"open": F.col("o_orderstatus") == "O"})
    return r.withColumn("rate_open", F.round("rate_open", 6))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def agg_12_contingency(spark: Spark, d: str) -> DataFrame:
    return aggs.contingency(t(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", ["O", "F"])


@query("SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def agg_13_group_sizes(spark: Spark, d: str) -> DataFrame:
    return aggs.group_sizes(t(spark, d, "lineitem"), ["l_orderkey"])


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n_peers, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS top FROM customer")
def agg_14_win_05_group_values(spark: Spark, d: str) -> DataFrame:
    return aggs.with_group_values(t(spark, d, "customer"), ["c_nationkey"], n_peers=F.count("*"), top=F.max("c_acctbal")).select("c_custkey", "n_peers", "top")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AND count(l_returnflag) = count(*) AS is_uniform FROM lineitem GROUP BY 1")
def agg_15_uniform(spark: Spark, d: str) -> DataFrame:
    return aggs.uniform_within(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT c_custkey, round(coalesce(v, median(v) OVER (PARTITION BY c_mktsegment)), 4) AS v FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS v FROM customer)")
def agg_17_impute_median(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    return aggs.impute_median(c, "v", ["c_mktsegment"]).select("c_custkey", F.round("v", 4).alias("v"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z FROM customer")
def agg_18_z_score(spark: Spark, d: str) -> DataFrame:
    return aggs.z_score(t(spark, d, "customer"), "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"))


@query("""SELECT 'l_quantity' AS covariate, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS mean_treated, round(avg(l_quantity) FILTER (l_returnflag <> 'R'), 6) AS mean_control,
round((avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R')) / sqrt((var_samp(l_quantity) FILTER (l_returnflag = 'R') + var_samp(l_quantity) FILTER (l_returnflag <> 'R')) / 2), 6) AS smd FROM lineitem""")
def agg_19_smd(spark: Spark, d: str) -> DataFrame:
    s = aggs.smd(t(spark, d, "lineitem"), F.col("l_returnflag") == "R", ["l_quantity"])
    return s.select("covariate", *[F.round(c, 6).alias(c) for c in ("mean_treated", "mean_control", "smd")])


@query("SELECT l_suppkey, round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 1) AS pct_returned FROM lineitem GROUP BY 1")
def agg_20_safe_percent(spark: Spark, d: str) -> DataFrame:
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0))
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(aggs.safe_percent(returned, F.sum("l_quantity")).alias("pct_returned"))


@query("""WITH s AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS y, user_id AS m FROM events), y AS (SELECT event_type, y, count(*) AS staff FROM s GROUP BY ALL),
w AS (SELECT *, lag(y) OVER (PARTITION BY event_type ORDER BY y) AS p, lag(staff) OVER (PARTITION BY event_type ORDER BY y) AS b FROM y),
k AS (SELECT w.event_type, w.y, count(*) AS kept FROM w JOIN s a ON a.event_type = w.event_type AND a.y = w.y JOIN s c ON c.event_type = w.event_type AND c.y = w.p AND c.m = a.m GROUP BY ALL),
x AS (SELECT w.*, coalesce(kept, 0) AS kept FROM w LEFT JOIN k USING (event_type, y))
SELECT event_type, count(*) AS n_years, CAST(coalesce(sum(staff - kept) FILTER (p IS NOT NULL), 0) AS BIGINT) AS entries, CAST(coalesce(sum(b - kept) FILTER (p IS NOT NULL), 0) AS BIGINT) AS exits,
coalesce(round(avg((staff - kept + b - kept) / (staff + b)) FILTER (p IS NOT NULL), 3), 0) AS turnover_rate, max(staff) AS max_staff FROM x GROUP BY 1""")
def agg_22_turnover(spark: Spark, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_type", F.to_date("ts").alias("y"), "user_id")
    return aggs.turnover(e, ["event_type"], "y", "user_id")


@query("""SELECT c_custkey, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 AS INTEGER) AS n_known FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey % 5 END AS b FROM customer)""")
def agg_23_agreement(spark: Spark, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    got = aggs.agreement([F.when(F.col("c_custkey") % 2 == 0, n), F.when(F.col("c_custkey") % 3 == 0, n % 5), n])
    return t(spark, d, "customer").select("c_custkey", got["n_known"].alias("n_known"))


@query("SELECT 0 AS pos, 'source' AS stage, count(*) AS n FROM orders UNION ALL SELECT 1, 'open', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 2, 'large', count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) FROM orders")
def agg_24_waterfall(spark: Spark, d: str) -> DataFrame:
    return aggs.waterfall(t(spark, d, "orders"), {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 200000})


@query("SELECT 'status:' || o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'n_customers', count(DISTINCT o_custkey) FROM orders")
def agg_25_tally(spark: Spark, d: str) -> DataFrame:
    return aggs.tally(t(spark, d, "orders"), "o_orderstatus", {"n_customers": F.count_distinct("o_custkey")})


@query("SELECT count(o_custkey) - count(DISTINCT o_custkey) AS n_duplicates FROM orders")
def agg_26_duplicates(spark: Spark, d: str) -> DataFrame:
    return aggs.duplicate_count(t(spark, d, "orders"), "o_custkey")


@query("SELECT max(s) AS largest, count(*) AS n_clusters FROM (SELECT count(*) AS s FROM orders GROUP BY o_custkey)")
def agg_31_clusters(spark: Spark, d: str) -> DataFrame:
    return aggs.group_sizes(t(spark, d, "orders"), ["o_custkey"]).agg(F.max("size").alias("largest"), F.sum("n_groups").alias("n_clusters"))


@query("SELECT 'c_mktsegment' AS column_name, count(*) FILTER (c_mktsegment IS NULL) AS n_null, count(*) FILTER (c_mktsegment = 'MACHINERY') AS n_literal, count(*) FILTER (c_mktsegment = '') AS n_empty, round(100.0 * count(*) FILTER (c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('', 'MACHINERY')) / count(*), 1) AS coverage_pct FROM customer")
def agg_32_null_profile(spark: Spark, d: str) -> DataFrame:
    return aggs.null_profile(t(spark, d, "customer"), ["c_mktsegment"], "MACHINERY")


# windows, ordering, sets ---------------------------------------------------------


@query("SELECT c_custkey, CAST(r AS INTEGER) AS pick_rank FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal < 0 DESC, md5('4|' || c_custkey), c_custkey) AS r FROM customer) ORDER BY r, c_nationkey, c_custkey LIMIT 60")
def win_01_round_robin_flagged(spark: Spark, d: str) -> DataFrame:
    c = windows.round_robin(t(spark, d, "customer"), "c_nationkey", "c_custkey", 60, 4, F.col("c_acctbal") < 0)
    return c.select("c_custkey", "pick_rank")


@query("SELECT c_custkey, CAST(r AS INTEGER) AS pick_rank FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('11|' || c_custkey), c_custkey) AS r FROM customer) ORDER BY r, c_nationkey, c_custkey LIMIT 60")
def win_01_round_robin(spark: Spark, d: str) -> DataFrame:
    return windows.round_robin(t(spark, d, "customer"), "c_nationkey", "c_custkey", 60, 11).select("c_custkey", "pick_rank")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def win_02_keep_first(spark: Spark, d: str) -> DataFrame:
    return joins.keep_first(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def win_03_latest(spark: Spark, d: str) -> DataFrame:
    return windows.latest(t(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey"], "y", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, y, lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS previous FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)")
def win_04_previous(spark: Spark, d: str) -> DataFrame:
    return windows.previous_period(t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")), ["o_custkey"], "y")


@query("SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_line, last_value(CASE WHEN role = 'user' THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations")
def win_07_heading_above(spark: Spark, d: str) -> DataFrame:
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.concat("role", F.col("turn").cast("string")).alias("h"))
    out = windows.heading_above(c, ["conv_id"], "turn", "h", F.col("role") == "user")
    return out.select("conv_id", "turn", F.regexp_replace("next_line", r"\d+$", "").alias("next_line"), "heading")


@query("SELECT conv_id, turn, sum(CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 1 AND turn % 3 <> 1 AS is_fenced FROM conversations")
def win_08_fences(spark: Spark, d: str) -> DataFrame:
    return windows.inside_fence(t(spark, d, "conversations"), ["conv_id"], "turn", F.col("turn") % 3 == 1).select("conv_id", "turn", "is_fenced")


@query("SELECT o_custkey, coalesce(min(s) >= -50000, true) AS is_monotone FROM (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders) GROUP BY 1")
def win_09_monotone(spark: Spark, d: str) -> DataFrame:
    return windows.monotone(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 50000.0)


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank FROM lineitem")
def win_10_average_ranks(spark: Spark, d: str) -> DataFrame:
    li = t(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"])
    return windows.average_ranks(li, "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("SELECT c_custkey FROM customer ORDER BY CAST(regexp_extract(c_name, '(\\d+)$', 1) AS INTEGER) DESC LIMIT 25")
def srt_02_04_suffix_limit(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").orderBy(windows.by_suffix(F.col("c_name")).desc()).limit(25).select("c_custkey")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def srt_03_top_one(spark: Spark, d: str) -> DataFrame:
    return windows.top_one(t(spark, d, "customer"), ["c_nationkey"], "c_acctbal", ["c_custkey"]).select("c_nationkey", "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY md5('3|' || o_custkey), o_custkey LIMIT 50)")
def srt_06_sample_groups(spark: Spark, d: str) -> DataFrame:
    return windows.sample_groups(t(spark, d, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", 50, 3)


@query("SELECT c_custkey, CASE WHEN h THEN 'medicaid' ELSE 'commercial' END AS first_arm, CASE WHEN h THEN 'commercial' ELSE 'medicaid' END AS second_arm FROM (SELECT c_custkey, substr(md5('5|' || c_custkey), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS h FROM customer)")
def srt_09_arm_order(spark: Spark, d: str) -> DataFrame:
    return windows.arm_order(t(spark, d, "customer", ["c_custkey"]), "c_custkey", ("medicaid", "commercial"), 5)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_01_union_all(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def set_02_distinct(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "part", ["p_brand", "p_type"]).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_03_intersect(spark: Spark, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(t(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("(SELECT c_custkey AS k, 'no_orders' AS side FROM customer EXCEPT SELECT o_custkey, 'no_orders' FROM orders) UNION ALL (SELECT o_custkey, 'no_customer' FROM orders EXCEPT SELECT c_custkey, 'no_customer' FROM customer)")
def set_04_tagged_difference(spark: Spark, d: str) -> DataFrame:
    return windows.tagged_difference(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"], ("no_orders", "no_customer"))


@query("SELECT count(*) AS n_keys, count(*) FILTER (k IN (SELECT o_custkey FROM orders)) AS n_contained, round(count(*) FILTER (k IN (SELECT o_custkey FROM orders)) / count(*), 6) AS containment FROM (SELECT DISTINCT c_custkey AS k FROM customer)")
def set_06_containment(spark: Spark, d: str) -> DataFrame:
    c = windows.containment(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")
    return c.withColumn("containment", F.round("containment", 6))
