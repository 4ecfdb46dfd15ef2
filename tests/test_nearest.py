import random

from pyspark.sql import functions as F

from plinth.operators import joins, ranges


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "a", "a", "b", "c"]), float(rng.randint(0, 60))) for i in range(300)] + [(900, "d", 1.0), (901, None, 1.0), (902, "a", None)]
    right = [(1000 + i, rng.choice(["a", "a", "b"]), float(rng.randint(0, 60) * 2)) for i in range(60)] + [(5000, "c", 7.0), (5001, "a", None), (5002, None, 3.0)]
    l = spark.createDataFrame(left, "u long, block string, score double").withColumn("_k", F.lit("own"))
    r = spark.createDataFrame(right, "c long, block string, value double")
    want = {}
    for u, b, s in left:
        near = sorted((abs(s - v), c, v) for c, x, v in right if x == b and v is not None) if b and s is not None else []
        want[u] = near[0][1:] if near else (None, None)
    for parts in (1, 7):
        got = joins.nearest(l.repartition(parts), r.repartition(parts), ["block"], "u", "score", "c", "value")
        assert {x.u: (x.c, x.value) for x in got.collect()} == want and got.columns == ["u", "block", "score", "_k", "c", "value"]
    assert joins.nearest(l, r.where("false"), ["block"], "u", "score", "c", "value").where("c is not null").count() == 0


def test_no_pairs_are_made(spark):
    """Every operator's rows stay within the input's: one block of 3,000 rows on both sides would give 9 million pairs."""
    l = spark.range(3000).selectExpr("id as u", "'a' as block", "double(id % 10) as score")
    r = spark.range(3000).selectExpr("id + 10000 as c", "'a' as block", "double(id) / 300 as value")
    plan = joins.nearest(l, r, ["block"], "u", "score", "c", "value")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text and plan.count() == 3000


def test_around_over_many_ranges(spark):
    rows = [(i, i % 13 if i % 9 == 0 and 40 < i < 160 else None) for i in range(200)]
    got = ranges.around(spark.createDataFrame(rows, "i int, v int").repartition(5), ["i"], F.col("v"), "b", "a").collect()
    for x in got:
        assert x.b == next((v for i, v in reversed(rows) if i <= x.i and v is not None), None)
        assert x.a == next((v for i, v in rows if i >= x.i and v is not None), None)


def test_medians_equal_the_plain_ones(spark):
    from plinth.operators import aggs

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None, "only null"]), rng.choice([None, *range(12)])) for _ in range(400)] + [("one", 5), ("two", 1), ("two", 4)]
    rows = [(g, None if g == "only null" else v) for g, v in rows]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)

    def middle(values):
        values = sorted(values)
        return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2

    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    assert {r.g: r.median for r in aggs.medians(df, ["g"], "v").collect()} == {g: middle(v) for g, v in groups.items() if v}
    assert [r.median for r in aggs.medians(df, [], "v").collect()] == [middle([v for _, v in rows if v is not None])]
    assert [r.median for r in aggs.medians(df.where("false"), [], "v").collect()] == [None] and aggs.summary(df.where("false"), [], "v").first().median is None
    filled = aggs.impute_median(df, "v", ["g"]).collect()
    assert len(filled) == len(rows) and all(r.v is not None for r in filled if r.g != "only null")
    assert len(aggs.z_score(df.where("false"), "v").collect()) == 0 and {r.z for r in aggs.z_score(df.withColumn("v", F.lit(3)), "v").collect()} == {0.0}


def test_best_by_gap_equals_best_candidate_of_all_pairs(spark):
    """Repeated and unknown keys and scores included; no pair is made."""
    rng = random.Random(9)
    left = [(rng.randint(0, 120), rng.choice(["a", "a", "b", "c", "d", None]), rng.choice([None, *range(9)])) for _ in range(200)]
    right = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 20, 2)])) for i in range(60)] + [(70, "c", None), (71, "c", None)]
    want = {}
    for u, b, s in left:
        for c, x, v in right:
            if b is not None and b == x:
                gap = None if s is None or v is None else float(abs(s - v))
                pair = (gap is None, gap or 0.0, c, gap)
                want[u] = min(want.get(u, pair), pair)
    l, r = spark.createDataFrame(left, "u long, block string, s int"), spark.createDataFrame(right, "c long, block string, v int")
    l, r = l.withColumn("s", F.col("s").cast("double")), r.withColumn("v", F.col("v").cast("double"))
    plan = joins.best_by_gap(l, r, ["block"], "u", "s", "c", "v")
    assert {x.u: (x.c, x.gap) for x in plan.collect()} == {u: (p[2], p[3]) for u, p in want.items()}
    assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()
