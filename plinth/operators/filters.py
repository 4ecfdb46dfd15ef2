"""Filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.ranges import previous
from plinth.sources.io import ContractError


def any_column_matches(df: DataFrame, pattern: str, columns: Sequence[str] | None = None) -> Column:
    """Whether a cell of the row matches, letter case aside; never null."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string").rlike(f"(?i){pattern}"), F.lit(False)) for c in (columns or df.columns)]
    return reduce(lambda a, b: a | b, cells, F.lit(False))


def not_listed(c: Column, terms: Sequence[str]) -> Column:
    """No term occurs in the lower-cased text; a null text has none."""
    body = "|".join(re.escape(t.lower()) for t in terms)
    return ~F.coalesce(F.lower(c).rlike(body), F.lit(False)) if terms else F.lit(True)


def not_matching(c: Column, pattern: str) -> Column:
    """The text, letter case aside, has no match; a null text has none."""
    return ~F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def included_rank(c: Column, include: str, exclude: str, rank: Column) -> Column:
    """`rank` where the text fits and isn't excluded, else null."""
    return F.when(c.rlike(include) & ~c.rlike(exclude), rank)


def membership(df: DataFrame, c: str, values: Sequence[str], keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows in (or not in) a list, a null counting as empty, and a one-row report of counts."""
    hit = F.coalesce(F.col(c), F.lit("")).isin(*values)
    stays = hit if keep else ~hit
    return df.where(stays), df.agg(F.count("*").alias("before"), F.count_if(stays).alias("after"))


def recent(df: DataFrame, year: str, back: int, most_removed: float = 0.5) -> DataFrame:
    """Rows at most `back` years before the latest year of the data; unknown years stay.

    If more than the given share of known rows would go, it is an error.
    """
    latest, known = df.agg(F.max(year), F.count(year)).first()
    if latest is None:
        return df
    cutoff = latest - back
    gone = df.where(F.col(year) < cutoff).count()
    if known and gone / known > most_removed:
        raise ContractError(f"{gone} of {known} known rows are before {cutoff}")
    return df.where(F.col(year).isNull() | (F.col(year) >= cutoff))


def whole_groups(df: DataFrame, key: Sequence[str], member: Column, how: str = "all", size: int | None = None) -> DataFrame:
    """Groups of which all members qualify ("all") or none is flagged ("none"), and of the size if given.

    Verdicts are aggregated with partial sums and joined back, so a hot group is no task's window.
    """
    ok = F.coalesce(member, F.lit(False))
    verdict = F.bool_and(ok) if how == "all" else ~F.bool_or(ok)
    stats = df.groupBy(*key).agg(verdict.alias("_ok"), F.count("*").alias("_size")).where("_ok")
    stats = stats.where(F.col("_size") == size) if size is not None else stats
    return df.join(stats.select(*key), list(key), "left_semi")


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def line_shape(c: Column, prefix: str, most: int, stop: str) -> Column:
    """Starts with the prefix, is short, and holds no stop word."""
    return c.startswith(prefix) & (F.length(c) < most) & ~c.rlike(stop)


def adjacent_equal(df: DataFrame, order: Sequence[str], value: str, partition: Sequence[str] = ()) -> DataFrame:
    """Rows whose value equals that of the row before them in the order."""
    if partition:
        seen = df.withColumn("_prev", F.lag(value).over(Window.partitionBy(*partition).orderBy(*order)))
    else:
        seen = previous(df, order, value, "_prev")
    return seen.where(F.col("_prev") == F.col(value)).drop("_prev")


def refuse(reason: str) -> None:
    """A retired entry point stops whoever calls it."""
    raise ContractError(reason)
