import random

from pyspark.sql import functions as F

from plinth.functions import geo


def test_rows_of_one_place_are_joined_as_lists_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(geo, "ROWS_OF_A_LIST", 4)
    rng = random.Random(3)
    places = [(rng.uniform(40, 41), rng.uniform(-75, -74)) for _ in range(12)] + [(None, 1.0)]
    row = lambda i: (i, f"x{i % 5}" if i % 3 else None, "s" if i % 2 else None, *(places[0] if i < 40 else rng.choice(places)))
    kind = "id int, name string, state string, lat double, lon double"
    a = spark.createDataFrame([row(i) for i in range(90)] + [row(7)], kind).coalesce(1)
    b = spark.createDataFrame([row(i) for i in range(120)], kind).coalesce(1)
    for on in (None, ["state"]):
        got = geo.within_miles(a, b, 25.0, on, digits=3)
        miles = F.round(geo.haversine_miles(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("right_lon")), 3)
        every = a.toDF(*[f"left_{c}" for c in a.columns]).crossJoin(b.toDF(*[f"right_{c}" for c in b.columns])).withColumn("miles", miles).where("miles <= 25")
        every = every.where("left_state = right_state") if on else every
        assert got.columns == every.columns and got.count() == every.count() > 1000
        assert got.exceptAll(every).isEmpty()
        assert got.select(F.spark_partition_id()).distinct().count() > 1  # both sides are one task's


def test_count_within_miles(spark):
    kind = "id int, lat double, lon double"
    a = spark.createDataFrame([(1, 40.0, -75.0), (2, 40.0, -75.0), (3, -40.0, 10.0), (4, None, 1.0), (5, 40.1, -75.0), (5, 40.0, -75.0)], kind)
    b = spark.createDataFrame([(i, 40.0 + i % 2, -75.0) for i in range(10)] + [(11, None, -75.0)], kind)
    got = {r.id: r.n for r in geo.count_within_miles(a, b, "id", 15.0).collect()}
    assert got == {1: 5, 2: 5, 3: 0, 4: 0, 5: 10}
