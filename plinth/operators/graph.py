"""Connected components by alternating large-star and small-star, as joins on minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of the string columns u and v; edges with a null are left out."""
    e = cut(edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = e.where("u = v").select("u")
    e, seen = cut(e.where("u <> v")), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v"))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).unionByName(loops.select(F.col("u").alias("node"))).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.join(e.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
