"""Global order without a global task: ranges of the order, numbered and summed up.

Rows are dealt into ranges of a total order and written to the checkpoint
folder with the number of their range. Everything that then needs the ranges
(counts, sums, neighbours) reads this one table: range boundaries are sampled,
so two exchanges over differently pruned rows need not agree on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.lineage import cut

#: Columns that `ranged` adds: the range, and a number that rises along the order.
PART, AT = "_part", "_at"


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """`df` in ranges of the order, checkpointed, plus PART and AT (gapless within a range but for its first value)."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(dealt.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().alias(AT)))


def number(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 0) -> DataFrame:
    """`name`, gapless along the order, and the columns of `df`; equal rows are numbered in any order."""
    marked = ranged(df, order)
    counts = marked.groupBy(PART).agg(F.count("*").alias("_n"), F.min(AT).alias("_first"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = counts.select(PART, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    out = marked.join(F.broadcast(bases), PART)
    return out.select((F.col("_base") + F.col(AT) + first).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def sum_before(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """`df` plus the sum of `value` over all rows before each row in the (total) order."""
    marked = ranged(df, order)
    sums = marked.groupBy(PART).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = sums.select(PART, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(bases), PART)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_within")).alias(name))


def previous(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """`df` plus the value of the row before each row in the (total) order."""
    marked = ranged(df, order)
    lasts = marked.groupBy(PART).agg(F.max_by(F.struct(F.col(value).alias("v")), AT).alias("_last"))
    edges = lasts.select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_edge"))  # one row for each range
    held = F.struct(F.col(value).alias("v"))
    inside = marked.withColumn("_inside", F.lag(held).over(Window.partitionBy(PART).orderBy(AT)))
    out = inside.join(F.broadcast(edges), PART)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_inside", "_edge")["v"].alias(name))


def around(df: DataFrame, order: Sequence[Column | str], value: Column, before: str, after: str) -> DataFrame:
    """`df` plus the last value that is not null at or before each row in the (total) order, and the first at or after it."""
    marked = ranged(df.withColumn("_value", value), order)
    known = F.when(F.col("_value").isNotNull(), F.col(AT))
    edges = marked.groupBy(PART).agg(F.max_by("_value", known).alias("_last"), F.min_by("_value", known).alias("_first"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(PART), F.desc(PART)))  # one row for each range
    carried = edges.select(PART, F.last("_last", True).over(up).alias("_up"), F.last("_first", True).over(down).alias("_down"))
    within = [Window.partitionBy(PART).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(AT), F.desc(AT))]
    inside = marked.withColumn(before, F.last("_value", True).over(within[0])).withColumn(after, F.last("_value", True).over(within[1]))
    out = inside.join(F.broadcast(carried), PART)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(before, "_up").alias(before), F.coalesce(after, "_down").alias(after))
