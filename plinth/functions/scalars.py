"""Small numeric, array, map and code helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dispersion(mean: Column, sd: Column) -> Column:
    """Negative-binomial theta from mean and standard deviation; null without overdispersion."""
    return F.when(sd * sd > mean, mean * mean / (sd * sd - mean))


def wald_interval(estimate: Column, error: Column, z: float = 1.959963984540054, exponentiate: bool = True) -> Column:
    """struct(estimate, low, high), on the link scale and then exponentiated."""
    f = F.exp if exponentiate else (lambda c: c)
    return F.struct(f(estimate).alias("estimate"), f(estimate - z * error).alias("low"), f(estimate + z * error).alias("high"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def censored(days: Column, event: Column, horizon: int) -> Column:
    """Days where the event was seen within the horizon, else horizon + 1."""
    return F.when(event & (days <= horizon), days).otherwise(horizon + 1)


def usable_number(c: Column) -> Column:
    """Finite and not zero."""
    n = c.cast("string").try_cast("double")
    return F.coalesce((n != 0) & ~F.isnan(n) & (F.abs(n) != float("inf")), F.lit(False))


def decode_transfers(code: Column) -> Column:
    """struct(transfers, transfers_censored): codes 1 to 4 are counts 0 to 3, the last censored; other codes are an error."""
    bad = code.isNotNull() & ~code.isin(1, 2, 3, 4)
    checked = F.when(bad, F.raise_error(F.lit("transfers has a value outside 1 to 4")).cast("int")).otherwise(code)
    return F.struct((checked - 1).alias("transfers"), F.coalesce(code == 4, F.lit(False)).alias("transfers_censored"))


def lookup(c: Column, values: Mapping[str, str], default: str | None = None) -> Column:
    """Literal map with a default."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def first_where(array: Column, condition: Callable[[Column], Column]) -> Column:
    """First element that fits, else the first element, else null."""
    return F.coalesce(F.get(F.filter(array, condition), F.lit(0)), F.get(array, F.lit(0)))


def parse_flag(c: Column) -> Column:
    """TRUE in any case, trimmed; null and the rest are false."""
    return F.coalesce(F.upper(F.btrim(c.cast("string"))) == "TRUE", F.lit(False))


def pair_of(code: Column) -> Column:
    """struct(pair, arm) of a sequential code: odd codes are arm 1."""
    return F.struct(F.floor((code + 1) / 2).alias("pair"), (code % 2).alias("arm"))
