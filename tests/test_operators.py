import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.functions import dates, geo
from plinth.operators import aggs, drift, filters, gates, joins, reshape, select, stats, windows
from plinth.sources import io
from plinth.sources.io import ContractError


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_business_days(spark):
    cases = [("2026-02-02", "2026-02-02", 0), ("2026-02-06", "2026-02-09", 1), ("2026-02-13", "2026-02-20", 4), ("2026-02-02", "2026-02-06", 4), ("2026-02-09", "2026-02-06", None), ("2026-02-02", "2026-02-16", 9), (None, "2026-02-06", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r.business_days for r in dates.add_business_days(df, "a", "b").orderBy("i").collect()] == [c[2] for c in cases]
    gates.business_days_gate(dates.add_business_days(df, "a", "b"), "a", "b", "business_days")
    with pytest.raises(ContractError):
        gates.business_days_gate(df.withColumn("business_days", F.lit(3)), "a", "b", "business_days")
    holidays = {r.day for r in dates.federal_holidays(spark).collect()}
    assert {datetime.date(2026, 7, 3), datetime.date(2022, 12, 26), datetime.date(2021, 12, 31), datetime.date(2026, 11, 26)} <= holidays


def test_distance_and_radius_join(spark):
    ny_la = spark.range(1).select(geo.haversine_miles(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437))).first()[0]
    assert 2400 < ny_la < 2500
    nulls = spark.range(1).select(geo.haversine_miles(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), float("inf"))).first()[0]
    assert nulls == float("inf")
    rng = random.Random(1)
    point = lambda i: (i, rng.choice([rng.uniform(-89, 89), rng.uniform(60, 62)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179.5, 180), rng.uniform(-180, -179.5)]))
    a = spark.createDataFrame([point(i) for i in range(150)] + [(999, None, 1.0)], "id int, lat double, lon double")
    b = spark.createDataFrame([point(i) for i in range(150)], "id int, lat double, lon double")
    for miles in (20.0, 150.0, 700.0):
        got = rows(geo.within_miles(a, b, miles).select("left_id", "right_id"))
        every = a.toDF("i", "la", "lo").crossJoin(b.toDF("j", "lb", "lp")).where(geo.haversine_miles(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")) <= miles)
        assert got == rows(every.select("i", "j"))


def test_greedy_match_equals_the_serial_loop(spark):
    rng = random.Random(2)
    edges = [(u, c, float(rng.randint(0, 20)), u) for u in range(30) for c in rng.sample(range(25), 6)]
    want, used = {}, set()
    for u in range(30):
        free = sorted((w, c) for x, c, w, _ in edges if x == u and c not in used)
        if free:
            want[u] = free[0][1]
            used.add(free[0][1])
    df = spark.createDataFrame(edges, "u int, c int, w double, o int")
    assert {r.u: r.c for r in select.greedy_match(df, "u", "c", "w", "o").collect()} == want
    assert {r.u: r.c for r in select.greedy_match(df.orderBy(F.rand(1)), "u", "c", "w", "o").collect()} == want
    assert select.greedy_match(df.limit(0), "u", "c", "w", "o").count() == 0


def serial_match(edges):
    want, used = {}, set()
    for u in sorted({e[0] for e in edges}):
        free = sorted((w, c) for x, c, w, _ in edges if x == u and c not in used)
        if free:
            want[u] = free[0][1]
            used.add(free[0][1])
    return want


def test_greedy_match_of_units_that_like_the_same(spark):
    # All units have one list of preferences: the loop goes on to the end, in bounded steps.
    df = spark.range(2000).withColumnRenamed("id", "u").select("u", F.explode(F.sequence(F.lit(0), F.lit(2099))).alias("c"))
    df = df.where((F.col("c") - F.col("u")).between(-40, 40) | (F.col("c") < 3)).withColumn("w", F.col("c").cast("double"))
    edges = [(r.u, r.c, r.w, r.u) for r in df.collect()]
    by_unit, used, want = {}, set(), {}
    for u, c, w, _ in edges:
        by_unit.setdefault(u, []).append((w, c))
    for u in sorted(by_unit):
        free = next((c for _, c in sorted(by_unit[u]) if c not in used), None)
        if free is not None:
            want[u] = free
            used.add(free)
    got = select.greedy_match(df.withColumn("o", F.col("u")), "u", "c", "w", "o", chunk=300)
    assert {r.u: r.c for r in got.collect()} == want
    few = [(u, c, 1.0, u) for u in range(30) for c in range(20)]
    small = spark.createDataFrame(few, "u int, c int, w double, o int")
    assert {r.u: r.c for r in select.greedy_match(small, "u", "c", "w", "o", chunk=7).collect()} == serial_match(few)
    blocks = spark.createDataFrame([(u, u % 3 * 100 + c, float(c % 4), u, "abc"[u % 3]) for u in range(40) for c in range(15)], "u int, c int, w double, o int, s string")
    want = serial_match([(r.u, r.c, r.w, r.o) for r in blocks.collect()])
    assert {r.u: r.c for r in select.greedy_match(blocks, "u", "c", "w", "o", block=["s"], chunk=4).collect()} == want


def test_disjoint_selection_of_a_chain(spark):
    # Each node shares a key with the next: every other one stays.
    chain = spark.range(400).select(F.col("id").alias("n"), F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("ks"), F.col("id").alias("rank"))
    for cap, chunk in ((1000, 50), (30, 50), (1000, 7)):
        got = {r.n: r.status for r in select.disjoint_selection(chain, "n", "ks", ["rank"], cap, chunk).collect()}
        last = min(cap * 2 - 2, 398)
        assert got == {n: "selected" if n % 2 == 0 and n <= last else "not_needed" if cap == 30 and n > last else "dropped_shares_key" for n in range(400)}


def test_disjoint_selection_equals_the_serial_loop(spark):
    rng = random.Random(3)
    nodes = [(i, rng.sample("abcdefghijklmnopqrst", 2), rng.random()) for i in range(40)] + [(90, [], 0.5), (91, ["z", "z"], 0.6)]
    want, holders, taken = {}, {}, 0
    for i, ks, _ in sorted(nodes, key=lambda n: n[2]):
        hit = next((holders[k] for k in ks if k in holders), None)
        if taken >= 8:
            want[i] = ("not_needed", None)
        elif hit is not None:
            want[i] = ("dropped_shares_key", str(hit))
        else:
            want[i] = ("selected", None)
            taken += 1
            holders.update({k: i for k in ks})
    df = spark.createDataFrame(nodes, "id int, keys array<string>, rank double")
    got = {r.id: (r.status, r.conflicts_with) for r in select.disjoint_selection(df, "id", "keys", ["rank"], 8).collect()}
    assert got == want
    assert {r.id for r in select.disjoint_selection(df, "id", "keys", ["rank"], 8).where("self_collision").collect()} == {91}


def test_blinded_slots(spark):
    df = reshape.cross_arms(spark.range(20).withColumnRenamed("id", "pair"), ["PE", "Non-PE"])
    for seed in (1, 2):
        got = select.blinded_slots(df, "pair", "arm", seed).collect()
        assert sorted(r.slot for r in got) == list(range(1, 41))
        for arm in ("PE", "Non-PE"):
            assert sum(r.slot % 2 for r in got if r.arm == arm) == 10
        by = {}
        for r in got:
            by.setdefault(r.pair, []).append(r.slot)
        assert all(abs(a - b) > 1 for a, b in by.values())
    with pytest.raises(ContractError):
        select.blinded_slots(df.where("pair < 3"), "pair", "arm")


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    right = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "k int, v int")
    with pytest.raises(ContractError, match="repeated keys"):
        joins.safe_join(left, right, ["k"])
    with pytest.raises(ContractError, match="find a match"):
        joins.safe_join(left, right.where("v <> 11"), ["k"], min_coverage=0.9)
    assert rows(joins.safe_join(left, right.where("v <> 11"), ["k"], min_coverage=0.6).select("k", "v")) == [(1, 10), (2, 20), (3, None)]
    assert rows(joins.first_match(left, right, ["k"], ["v"], ["v"]).select("k", "v")) == [(1, 10), (2, 20), (3, None)]
    with pytest.raises(Exception, match="no match"):
        joins.first_match(left, right, ["k"], ["v"], ["v"], required=True).collect()
    assert rows(joins.unique_or_ambiguous(left, right, ["k"], "v").select("k", "v", "status")) == [(1, None, "ambiguous"), (2, 20, "unique"), (3, None, "unmatched")]
    with pytest.raises(Exception, match="has no"):
        joins.lookup_join(left, right.where("v = 10"), "k", "v").collect()
    sheet = spark.createDataFrame([("1.0",), (" 2",), ("9",)], "npi string")
    from plinth.functions.keys import npi_key

    assert rows(joins.keyed_join(sheet, right.where("v <> 11"), "npi", "k", npi_key, ["v"], ["v"]).select("v")) == rows(spark.createDataFrame([(10,), (20,), (None,)], "v int"))
    pairs = joins.either_key(left, spark.createDataFrame([(7, "a", 2), (8, "z", 1)], "id int, x string, k int"), [["x"], ["k"]], "k", "id")
    assert rows(pairs) == [(1, 7), (1, 8), (2, 7)]


def test_places_and_their_coordinates(spark):
    places = spark.createDataFrame([("Denver ", "co", 1.0, 2.0), ("DENVER", "CO", 0.5, 9.0), ("Reno", "NV", None, 1.0), ("St  Paul", "MN", 3.0, 4.0)], "city string, state string, LAT double, lng double")
    found = geo.gazetteer(places)
    assert rows(found) == [("DENVER", "CO", 0.5, 9.0), ("ST PAUL", "MN", 3.0, 4.0)]
    people = spark.createDataFrame([(1, "denver", "CO"), (2, "reno", "NV"), (3, "st paul", "mn"), (4, None, "MN")], "id int, c string, s string")
    over = spark.createDataFrame([("ST PAUL", "MN", 8.0, 8.0)], "city string, state string, lat double, lon double")
    assert rows(geo.with_coordinates(people, "c", "s", found, over).select("id", "lat", "coordinates_via")) == [(1, 0.5, "gazetteer"), (2, None, None), (3, 8.0, "override"), (4, None, None)]
    for bad in (places.limit(0), places.drop("lng")):
        with pytest.raises(ContractError):
            geo.gazetteer(bad)


def test_join_report_and_ceiling(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (4,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d"), (None, "e")], "k int, v string")
    assert tuple(joins.join_report(left, right, ["k"]).first()) == (4, 2, 0.5, 3, 1, 1.25)
    with pytest.raises(ContractError, match="rows of each"):
        joins.safe_join(left, right, ["k"], unique=False, max_growth=1.2)
    assert joins.safe_join(left, right, ["k"], unique=False, max_growth=1.25).count() == 5


def test_keep_first_does_not_hang_on_row_order(spark):
    df = spark.createDataFrame([(i % 5, (i * 37) % 100, i) for i in range(100)], "k int, o int, v int")
    a, b = (rows(joins.keep_first(x, ["k"], ["o", "v"])) for x in (df, df.orderBy(F.rand(3))))
    assert a == b and len(a) == 5


def test_ids(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), (None, 2), ("b", 4), (None, 5)], "k string, o int")
    assert sorted((r.o, r.id) for r in reshape.sequential_id(df, ["o"], "id", 2001).collect()) == [(i, 2000 + i) for i in range(1, 6)]
    assert sorted((r.o, r.g) for r in reshape.dense_id(df, F.col("k"), ["o"], "g", "office_").collect()) == [(1, "office_1"), (2, "office_2"), (3, "office_3"), (4, "office_3"), (5, "office_4")]


def test_ids_of_wide_rows_are_unique(spark):
    # Narrow and wide readers sample different range boundaries; ids may not hang on them.
    wide = spark.range(0, 120_000, 1, 6).select("id", F.xxhash64("id").alias("o"), *[F.concat(F.lit("x" * 20), (F.col("id") * k).cast("string")).alias(f"c{k}") for k in range(8)])
    got = reshape.sequential_id(wide, ["o"], "n", 1)
    assert got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (120_000, 1, 120_000)
    assert got.join(wide.select("id", F.row_number().over(Window.orderBy("o")).alias("want")), "id").where("n <> want").isEmpty()


def test_ranks_sums_and_neighbours_over_ranges(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([None, rng.randint(0, 60)]), rng.choice("xy")) for i in range(500)]
    df = spark.createDataFrame(data, "id int, v int, g string")
    values = sorted(v for _, v, _ in data if v is not None)
    want = {v: values.index(v) + (values.count(v) + 1) / 2 for v in values}
    assert {r.id: r.avg_rank for r in windows.average_ranks(df, "v").collect()} == {i: want[v] for i, v, _ in data if v is not None}
    own = {g: sorted(v for _, v, h in data if h == g and v is not None) for g in "xy"}
    by = {r.id: r.avg_rank for r in windows.average_ranks(df, "v", ["g"]).collect()}
    assert by == {i: own[g].index(v) + (own[g].count(v) + 1) / 2 for i, v, g in data if v is not None}
    same = [i for (i, v, _), (_, u, _) in zip(data[1:], data) if v is not None and v == u]
    assert sorted(r.id for r in filters.adjacent_equal(df, ["id"], "v").collect()) == same
    sheet = [tuple(r) for r in io.titled_sheet(df, ["a", "b"], ["id"], ["id"]).orderBy("pos").collect()]
    assert sheet[:3] == [(1, "a"), (2, "b"), (3, '"0"')] and sheet[-1] == (502, '"499"')


def test_groups_and_balance(spark):
    df = spark.createDataFrame([(1, True, 1.0), (1, True, 2.0), (2, True, 3.0), (2, None, 4.0), (3, True, 9.0)], "pair int, ok boolean, x double")
    assert {r.pair for r in filters.whole_groups(df, ["pair"], F.col("ok")).collect()} == {1, 3}
    assert {r.pair for r in filters.whole_groups(df, ["pair"], F.col("ok"), size=2).collect()} == {1}
    assert aggs.smd(df, F.col("pair") == 99, ["x"]).first().smd is None
    assert aggs.smd(df.withColumn("x", F.lit(1.0)), F.col("pair") == 1, ["x"]).first().smd == 0.0
    with pytest.raises(ContractError):
        filters.recent(spark.createDataFrame([(2000,), (2001,), (2020,)], "y int"), "y", 2)
    with pytest.raises(ContractError):
        aggs.checked_funnel([("source", 10), ("eligible", None)])
    with pytest.raises(ContractError):
        aggs.checked_funnel([("source", 10), ("eligible", 11)])


def test_turnover(spark):
    panel = spark.createDataFrame([("a", 2013, "x"), ("a", 2013, "x"), ("a", 2013, "y"), ("a", 2015, "y"), ("a", 2015, "z"), ("b", 2014, "q")], "office string, year int, npi string")
    assert rows(aggs.turnover(panel, ["office"], "year", "npi")) == [("a", 2, 1, 1, 0.5, 2), ("b", 1, 0, 0, 0.0, 1)]


def test_exact_tests_of_large_counts():
    def every_table(a, b, c, d):
        r1, r2, k = a + b, c + d, a + c
        log_p = lambda x: -sum(map(math.lgamma, (x + 1, r1 - x + 1, k - x + 1, r2 - k + x + 1)))
        logs = [log_p(x) for x in range(max(0, k - r2), min(r1, k) + 1)]
        top = max(logs)
        return sum(math.exp(x - top) for x in logs if x <= log_p(a) + 1e-7) / sum(math.exp(x - top) for x in logs)

    rng = random.Random(8)
    for _ in range(300):
        t = [rng.randint(0, rng.choice([3, 40])) for _ in range(4)]
        assert stats.fisher_exact(*t) == pytest.approx(every_table(*t), rel=1e-9)
    assert stats.fisher_exact(50_000_000, 50_000_000, 50_000_000, 50_000_000) == pytest.approx(1.0, abs=1e-3)
    assert 0 < stats.fisher_exact(50_010_000, 49_990_000, 50_000_000, 50_000_000) < 1
    assert stats.binomial_two_sided(500_000_000, 1_000_000_000) == pytest.approx(1.0, abs=1e-3)


def test_statistics(spark):
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert stats.binomial_two_sided(1, 10) == pytest.approx(0.021484375) and stats.binomial_two_sided(5, 10) == pytest.approx(1.0)
    assert stats.chi2_tail(3.841458820694124) == pytest.approx(0.05) and stats.chi2_tail(20.0, 10) == pytest.approx(0.0292526881)
    assert stats.ks_p(0.5, 100) < 1e-6 and stats.ks_p(0.01, 100) > 0.99
    y = spark.createDataFrame([(float(i), float(2 * i + 1)) for i in range(20)], "x double, y double")
    assert stats.fit_glm(y, "y", ["x"], "gaussian")["coefficients"] == pytest.approx([1.0, 2.0], abs=1e-6)
    with pytest.raises(ContractError):
        stats.convergence_gate({"converged": False, "positive_definite": True})
    table = spark.createDataFrame([(1.22, 10, 200, 400, 800, 0.87, 200)], "IRR double, SD int, Pairs int, Physicians int, Total_Calls int, Power double, Usable_Fits int")
    gates.power_table_gate(table)
    with pytest.raises(ContractError):
        gates.power_table_gate(table.withColumn("Power", F.lit(1.2)))
    w = spark.range(2000).select(F.avg(stats.poisson_weight("id", draw=4))).first()[0]
    assert 0.9 < w < 1.1


def test_family_gate(spark):
    good = spark.range(200).select(((F.col("id") + 0.5) / 200).alias("p"), F.col("id").alias("n"))
    gates.check_family(good, "p", "percentile")
    gates.check_family(good, "n", "count")
    for column, family in ((F.lit(0.5), "percentile"), (F.lit(-1), "count"), (F.lit(1.5), "count"), (F.lit(101), "proportion"), (F.lit("x"), "continuous"), (F.lit(1), "odd")):
        with pytest.raises(ContractError):
            gates.check_family(good.withColumn("v", column), "v", family)
    with pytest.raises(ContractError):
        gates.check_family(good.withColumn("p", F.greatest("p", F.lit(0.01))), "p", "percentile")
    with pytest.raises(ContractError):
        gates.provenance_gate(good, {"p": ("simulated", "percentile")}, ["p"])


def test_missingness_and_population_gates(spark):
    df = spark.createDataFrame([(i // 2, "PE" if i % 2 else "Non-PE", True, None if i % 2 and i < 60 else 1.0) for i in range(80)], "pair int, arm string, ok boolean, x double")
    with pytest.raises(ContractError):
        gates.missingness_gate(df, "arm", ["x"])
    gates.missingness_gate(df.withColumn("x", F.lit(1.0)), "arm", ["x"])
    gates.population_gate(df, "pair", "arm", "ok", 40)
    with pytest.raises(ContractError):
        gates.population_gate(df, "pair", "arm", "ok", 41)
    with pytest.raises(ContractError):
        gates.population_gate(df.withColumn("ok", F.col("pair") != 3), "pair", "arm", "ok")
    cells = df.groupBy("arm").agg(F.count("*").alias("n"))
    gates.cells_gate(df, ["arm"], cells.withColumn("n", F.lit(42)), tolerance=2 / 42)
    with pytest.raises(ContractError):
        gates.cells_gate(df, ["arm"], cells.withColumn("n", F.lit(43)), tolerance=0.05)


def test_row_rules_report_and_survive(spark):
    df = spark.createDataFrame([(1, "a", "PE"), (1, " ", "PE"), (3, "NA", "X")], "id int, name string, arm string")
    found = gates.all_findings(spark, [
        ("rows", lambda: gates.rule_row_count(df, 3)), ("unique", lambda: gates.rule_unique(df, ["id"])), ("non_empty", lambda: gates.rule_non_empty(df, ["name"])),
        ("domain", lambda: gates.rule_domain(df, {"arm": ["PE", "Non-PE"]})), ("ids", lambda: gates.rule_id_coverage(df, ["id"], 3)), ("differ", lambda: gates.rule_differ(df, "name", "arm")),
        ("broken", lambda: gates.rule_unique(df, ["nope"])), ("forms", lambda: gates.rule_known_forms(df.withColumn("visit_complete", F.lit(1)), spark.createDataFrame([("call",)], "form string"), "form")),
    ])
    got = {(r.rule, r.n) for r in found.collect()}
    assert got == {("unique", 1), ("non_empty", 1), ("domain", 1), ("id_coverage", 2), ("cannot_run", 1), ("known_forms", 1)}


def test_round_robin_and_sampling(spark):
    df = spark.createDataFrame([(i, f"g{i % 4 if i < 30 else 0}") for i in range(60)], "id int, g string")
    got = windows.round_robin(df, "g", "id", 10, 5).collect()
    assert [r.pick_rank for r in got] == sorted(r.pick_rank for r in got) and len(got) == 10
    assert {r.id for r in got} == {r.id for r in windows.round_robin(df.orderBy(F.rand(1)), "g", "id", 10, 5).collect()}
    assert windows.sample_groups(df, "g", 2, 1).select("g").distinct().count() == 2
    assert windows.one_per_group(df, "g", "id", 1).count() == 4


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,zip\n1,NA,01234\n2,"x, y",\n')
    strings = io.read_csv_strings(spark, str(tmp_path / "a.csv"))
    assert rows(strings) == [("1", "NA", "01234"), ("2", "x, y", "")]
    assert rows(io.with_null_tokens(strings)) == [("1", None, "01234"), ("2", "x, y", None)]
    assert rows(io.typed(strings, {"id": "int", "name": "int"}).select("id", "name")) == [(1, None), (2, None)]
    (tmp_path / "p.txt").write_text("title\nk|v\n")
    assert rows(io.read_headless(spark, str(tmp_path / "p.txt"), ["a", "b"], F.col("a") == "title", sep="|")) == [("k", "v")]
    (tmp_path / "plan.txt").write_text("# c\nfamily = nbinom = 2\n\nn=3\n")
    assert rows(io.read_settings(spark, str(tmp_path / "plan.txt"))) == [("family", "nbinom = 2"), ("n", "3")]
    out = str(tmp_path / "t.parquet")
    df = spark.range(3)
    assert io.replace_table(df, out)["applied"] is False and not (tmp_path / "t.parquet").exists()
    io.replace_table(df, out, apply=True)
    plan = io.replace_table(spark.read.parquet(out).where("id > 0"), out, apply=True)
    assert plan["replaces"] and spark.read.parquet(out).count() == 2 and spark.read.parquet(plan["backup"]).count() == 3
    assert io.provenance(df, "o", ["a"], "s").first().digest == io.provenance(df.orderBy(F.desc("id")), "o", ["a"], "s").first().digest
    once = str(tmp_path / "once.parquet")
    for n in (5, 4, 3):
        io.replace_table(spark.range(n), once, apply=True, backup="once")
    assert spark.read.parquet(once).count() == 3 and spark.read.parquet(f"{once}.original").count() == 5
    (tmp_path / "lock.txt").write_text("# c\nalpha 1.0 x y\n\nbeta  2.0 z\n")
    assert rows(io.read_records(spark, str(tmp_path / "lock.txt"), ["p", "v", "rest"])) == [("alpha", "1.0", "x y"), ("beta", "2.0", "z")]
    with pytest.raises(Exception, match="4 fields needed"):
        io.read_records(spark, str(tmp_path / "lock.txt"), ["p", "v", "a", "b"]).collect()
    made = io.provenance(df, "o", {"t": spark.read.parquet(out)}, "s").collect()
    assert [(r.role, r.name, r.n_rows) for r in made] == [("output", "o", 3), ("source", "t", 2)]
    with pytest.raises(ContractError):
        io.require_tables(spark, str(tmp_path), {"t": 5})
    with pytest.raises(ContractError):
        io.require_input("PATH", None)
    assert io.parameters(["--n=3", "--dry-run"], n="1", dry_run=False) == {"n": "3", "dry_run": True}
    edited = io.edit_dictionary(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "pos int, name string, label string"), "pos", "name", {"a": {"label": "z"}}, ["b"], {"a": {"name": "c", "label": "w"}})
    assert rows(edited.select("pos", "name", "label")) == [(1, "a", "z"), (2, "c", "w")]


def test_drift(spark):
    declared = spark.createDataFrame([("a", "OR"), ("b", "IRR")], "label string, scale string")
    used = spark.createDataFrame([("a", "IRR", True), ("c", "OR", False)], "label string, scale string, is_literal boolean")
    assert rows(drift.estimand_drift(declared, used)) == [("a", "hard_coded"), ("a", "scale_drift"), ("b", "orphaned"), ("c", "unknown")]
    lines = spark.createDataFrame([("library(dplyr)",), ("x <- tidyr::pivot(1) # library(none)",), ('require("mgcv")',)], "value string")
    assert rows(drift.loaded_packages(lines, ["mgcv"])) == [("dplyr",), ("tidyr",)]
    steps = spark.createDataFrame([("a", True, 20, False), ("b", True, None, False), ("c", True, 5, True), ("d", False, None, True)], "step string, is_blocking boolean, timeout_minutes int, continue_on_error boolean")
    assert rows(drift.ci_contract(steps)) == [("a", "timeout_too_long"), ("b", "no_timeout"), ("c", "may_fail")]


def test_practices_and_roster(spark):
    from plinth.operators.practices import Platform, practices, refresh_roster

    page = '<html><head><title>T</title><meta property="og:locality" content="Reno"></head><h1>Head</h1><script>data = {"name": "N } x", "tel": 1};</script><a href="/doc/a?x=1">1</a><a href="/doc/a">2</a><p>call 303-555-0100</p></html>'
    pages = spark.createDataFrame([("a", page, "u1"), ("b", page, "u2"), ("a", None, "u3"), ("z", page, "u4")], "platform string, html string, url string")
    got = {r.url: r for r in practices(pages, [Platform("a", marker="data =", provider_path="/doc/"), Platform("b", defaults=(("state", "NV"),))]).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert (got["u1"].name, got["u1"].city, got["u1"].phone, got["u1"].provider_urls) == ("N } x", "Reno", "303-555-0100", ["/doc/a"])
    assert (got["u2"].name, got["u2"].state, got["u2"].provider_urls) == ("Head", "NV", [])
    assert got["u3"].name is None
    kind = "platform string, provider_url string, provider_name string, credentials string, state string"
    old = spark.createDataFrame([("a", "/1", "Ann Lee", "MD", "CO"), ("b", "/2", "Bo Ray", "DO", "NV")], kind)
    new = spark.createDataFrame([("b", "/9", "Bo Ray", "D.O.", "nv"), ("b", "/8", "Cy Fox", "CNM", "NV"), ("b", "/7", "Di Poe", "MD", "NV")], kind)
    ids = spark.createDataFrame([("/1", "Ann Lee", "CO", "11"), ("/2", "Bo Ray", "NV", "22"), ("/5", "Di Poe", "NV", "55"), ("/6", "Di Poe", "NV", "66"), ("/7", None, None, None)], "provider_url string, provider_name string, state string, npi string")
    out = {r.provider_url: (r.origin, r.npi, r.id_via) for r in refresh_roster(old, new, ids).collect()}
    assert out == {"/1": ("retained", "11", "url"), "/9": ("rebuilt", "22", "name"), "/7": ("rebuilt", None, None)}


def test_ks_p_of_a_perfect_fit_of_many_rows():
    from plinth.operators.stats import ks_p

    assert ks_p(0.5 / 9_000_000, 9_000_000) == 1 and ks_p(1e-300, 10**12) == 1
    # both series where they meet, and published values of Kolmogorov's distribution
    at = lambda t: ks_p(t / (1e6 + 0.12 + 0.11e-6), 10**12)
    assert abs(at(1 - 1e-9) - at(1 + 1e-9)) < 1e-8
    assert abs(at(0.5) - 0.9639) < 1e-4 and abs(at(0.8276) - 0.5) < 1e-3 and abs(at(1.3581) - 0.05) < 1e-4


def test_either_key_holds_no_pairs(spark):
    """Each pair once, repeated and null ids and keys included; unique ids need no distinct of pairs."""
    from plinth.operators import joins

    rows = [(i, i % 5 if i % 7 else None, i % 3, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int")
    agrees = lambda x, y: (x[1] is not None and x[1] == y[1]) or x[2:] == y[2:]
    plan = joins.either_key(df, df, [["a"], ["b", "c"]], "id", "id")
    assert sorted(map(tuple, plan.collect())) == sorted((x[0], y[0]) for x in rows for y in rows if agrees(x, y))
    assert "HashAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    twice = df.unionByName(df.withColumn("a", df["a"] + 1)).unionByName(spark.createDataFrame([(None, 1, 1, 1)] * 2, df.schema))
    more = [tuple(r) for r in twice.collect()]
    want = {(x[0], y[0]) for x in more for y in more if agrees(x, y)}
    got = [tuple(r) for r in joins.either_key(twice, twice, [["a"], ["b", "c"]], "id", "id").collect()]
    assert len(got) == len(want) and set(got) == want
