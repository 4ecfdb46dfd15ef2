"""Business days and date parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST_YEAR, LAST_YEAR = 2021, 2036


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (1 = Sunday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1))


def _last_monday(year: Column, month: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.dayofweek(last) - 2, F.lit(7)))


def _observed(day: Column) -> Column:
    """A holiday on Saturday is kept on Friday, one on Sunday on Monday."""
    return F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)


def federal_holidays(spark: SparkSession, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """`day` of each observed United States federal holiday, from the rules; next year's New Year may fall in a year's end."""
    y = F.col("y")
    fixed = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))]
    moving = [_nth(y, 1, 2, 3), _nth(y, 2, 2, 3), _last_monday(y, 5), _nth(y, 9, 2, 1), _nth(y, 10, 2, 2), _nth(y, 11, 5, 4)]
    days = F.array(*[_observed(d) for d in fixed], *moving)
    return spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("y")).select(F.explode(days).alias("day")).distinct()


def business_calendar(spark: SparkSession, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """day, is_business and `index`, the number of business days up to it; a few thousand rows, fixed by the years."""
    span = spark.sql(f"select explode(sequence(make_date({first_year}, 1, 1), make_date({last_year}, 12, 31))) as day")
    off = federal_holidays(spark, first_year, last_year).withColumn("_off", F.lit(True))
    marked = span.join(F.broadcast(off), "day", "left")
    business = ~F.dayofweek("day").isin(1, 7) & F.col("_off").isNull()
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("day", business.alias("is_business")).withColumn("index", F.sum(F.col("is_business").cast("int")).over(running))


def add_business_days(df: DataFrame, start: str, end: str, name: str = "business_days", calendar: DataFrame | None = None) -> DataFrame:
    """Business days after `start` up to and including `end`; null if either is null, outside the calendar, or reversed."""
    index = F.broadcast((calendar or business_calendar(df.sparkSession)).select("day", "index"))
    a, b = index.toDF("_start", "_a"), index.toDF("_end", "_b")
    out = df.join(a, F.to_date(F.col(start)) == F.col("_start"), "left").join(b, F.to_date(F.col(end)) == F.col("_end"), "left")
    span = F.when(F.to_date(F.col(end)) >= F.to_date(F.col(start)), F.col("_b") - F.col("_a"))
    return out.select(*[F.col(c) for c in df.columns if c != name], span.cast("int").alias(name))


def calendar_days(start: Column, end: Column) -> Column:
    return F.date_diff(F.to_date(end), F.to_date(start))


def year_of(c: Column) -> Column:
    """Year prefix of an ISO date or a plain year; null if there is none."""
    return F.substring(F.btrim(c.cast("string")), 1, 4).try_cast("int")


def years_in_practice(graduated: Column, enumerated: Column, study_year: int) -> Column:
    """Study year less graduation year, else less enumeration year; never negative."""
    return F.greatest(F.lit(study_year) - F.coalesce(year_of(graduated), year_of(enumerated)), F.lit(0))


#: Fixed value: hours between two calls to one office.
MIN_HOURS_BETWEEN_CALLS = 48


def run_stamp(c: Column) -> Column:
    """`yyyymmdd_hhmmss` of a time, for names of files and sidecars."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def spaced(df: DataFrame, keys: list[str], at: str, hours: int = MIN_HOURS_BETWEEN_CALLS) -> DataFrame:
    """`df` plus hours_since (the row before of the same keys) and is_spaced: at least `hours` after it."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    since = (F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))) / 3600
    return df.withColumns({"hours_since": since, "is_spaced": F.coalesce(since >= hours, F.lit(True))})
