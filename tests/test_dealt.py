from pyspark.sql import functions as F

from plinth.operators import joins


def test_parts_grow_with_the_rows_and_serve_groups_and_joins(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_OF_A_PART", 50)
    rows = joins.dealt(spark.range(1000).select((F.col("id") % 300).alias("k"), "id"), ["k"])
    low = rows.groupBy("k").agg(F.min("id").alias("low"))
    out = joins.safe_join(rows, low, ["k"])
    assert rows.rdd.getNumPartitions() == 20
    assert out.count() == 1000 and out.where("low <> k").isEmpty()
