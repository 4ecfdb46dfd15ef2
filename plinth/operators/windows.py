"""Windows, ordering, sampling and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.joins import keep_first
from plinth.operators.ranges import sum_before


def seeded(seed: int, *values: Column) -> Column:
    """A seeded order of values: hexadecimal digits that any system with md5 can give again; null counts as `\\N`."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("\\N")) for v in values]).cast("binary"))


def hashed(seed: int, *keys: str) -> Column:
    """A seeded order that depends on the keys alone."""
    return seeded(seed, *[F.col(k) for k in keys])


def round_robin(df: DataFrame, group: str, key: str, n: int, seed: int = 0, first: Column | None = None) -> DataFrame:
    """The first n rows in order of (rank within group, group): every group gives one before any gives two.

    Within a group rows flagged `first` lead, then a seeded hash. A rank over n
    can't be chosen, so groups are cut to n by partial top-k before the sort.
    """
    lead = F.coalesce(first, F.lit(False)) if first is not None else F.lit(False)
    w = Window.partitionBy(group).orderBy(lead.desc(), hashed(seed, key), F.col(key))
    ranked = df.withColumn("pick_rank", F.row_number().over(w)).where(F.col("pick_rank") <= n)
    return ranked.orderBy("pick_rank", F.col(group).asc_nulls_last(), key).limit(n)


def latest(df: DataFrame, keys: Sequence[str], year: str, tiebreak: Sequence[str]) -> DataFrame:
    """The latest row of each key."""
    return keep_first(df.where(F.col(year).isNotNull()).withColumn("_back", -F.col(year)), keys, ["_back", *tiebreak]).drop("_back")


def previous_period(df: DataFrame, keys: Sequence[str], period: str, name: str = "previous") -> DataFrame:
    """Each observed period of a key with the one observed before it."""
    seen = df.select(*keys, period).distinct()
    return seen.withColumn(name, F.lag(period).over(Window.partitionBy(*keys).orderBy(period)))


def heading_above(df: DataFrame, doc: Sequence[str], line: str, text: str, is_heading: Column) -> DataFrame:
    """The next line, and the last heading at or above each line of a document."""
    w = Window.partitionBy(*doc).orderBy(line)
    above = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"next_line": F.lead(text).over(w), "heading": F.last(F.when(is_heading, F.col(text)), ignorenulls=True).over(above)})


def inside_fence(df: DataFrame, doc: Sequence[str], line: str, is_fence: Column, name: str = "is_fenced") -> DataFrame:
    """Whether a line is inside a fenced block, by parity of the fences so far; fence lines are not inside."""
    w = Window.partitionBy(*doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, (F.sum(is_fence.cast("int")).over(w) % 2 == 1) & ~is_fence)


def monotone(df: DataFrame, by: Sequence[str], order: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Whether the value never falls by more than the tolerance along the order."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_step", step).groupBy(*by).agg(F.coalesce(F.min("_step") >= -tolerance, F.lit(True)).alias("is_monotone"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Mid-ranks: distinct values are ranked from their counts, so ties and hot values cost one row and no task ranks them all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_ties"))
    # Distinct values of all groups in one order: a group's ranks start where the rows of the groups before end.
    summed = sum_before(counts, [*by, value], "_ties", "_before")
    if by:
        own = [F.col(c).alias(f"_of_{c}") for c in by]
        starts = summed.groupBy(*own).agg(F.min("_before").alias("_start"))
        summed = summed.join(starts, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    start = F.col("_start") if by else F.lit(0)
    ranks = summed.select(*by, value, (F.col("_before") - start + (F.col("_ties") + 1) / 2).alias(name), F.col("_ties").alias("n_ties"))
    return df.join(ranks, [*by, value])


def by_suffix(c: Column) -> Column:
    """The number at the end of `pair_12`."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")


def custom_order(c: Column, values: Sequence[str]) -> Column:
    """Position in a list; what isn't in it sorts last."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(at > 0, at)


def top_one(df: DataFrame, keys: Sequence[str], score: str, tiebreak: Sequence[str]) -> DataFrame:
    """The highest score of each key; ties by `tiebreak`."""
    return keep_first(df.where(F.col(score).isNotNull()).withColumn("_s", -F.col(score)), keys, ["_s", *tiebreak]).drop("_s")


def sample_groups(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of n groups in a seeded order."""
    chosen = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(hashed(seed, group), group).limit(n)
    return df.join(chosen, group, "left_semi")


def one_per_group(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """One row of each group by a seeded order."""
    return keep_first(df, [group], [hashed(seed, key), key])


def arm_order(df: DataFrame, key: str, arms: tuple[str, str], seed: int = 0) -> DataFrame:
    """A seeded first arm for each row and the other as second."""
    heads = F.substring(hashed(seed, key), 1, 1).isin(*"02468ace")
    a, b = F.lit(arms[0]), F.lit(arms[1])
    return df.withColumns({"first_arm": F.when(heads, a).otherwise(b), "second_arm": F.when(heads, b).otherwise(a)})


def tagged_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], tags: tuple[str, str]) -> DataFrame:
    """Distinct keys of one side only, tagged with the side."""
    x, y = a.select(*keys), b.select(*keys)
    return x.subtract(y).withColumn("side", F.lit(tags[0])).unionByName(y.subtract(x).withColumn("side", F.lit(tags[1])))


def containment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Share of a's distinct keys that b has."""
    mine = a.select(key).where(F.col(key).isNotNull()).distinct()
    theirs = b.select(key).distinct().withColumn("_in", F.lit(1))
    return mine.join(theirs, key, "left").agg(F.count("*").alias("n_keys"), F.count("_in").alias("n_contained"), F.try_divide(F.count("_in"), F.count("*")).alias("containment"))
