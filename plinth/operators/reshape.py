"""Projections and reshapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranges import number


def pick(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns by old name in the order given, under new names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df` without these columns; names that it has not are no error."""
    return df.drop(*names)


def align(df: DataFrame, columns: Sequence[str], fill: str | None = None) -> DataFrame:
    """Exactly these columns; ones that are missing are filled."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(fill).cast("string").alias(c) for c in columns])


def stack(parts: Mapping[str, DataFrame], label: str, columns: Sequence[str]) -> DataFrame:
    """Tables of one shape over each other with a literal label."""
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias(label), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def sequential_id(df: DataFrame, order: Sequence[Column | str], name: str = "id", first: int = 1) -> DataFrame:
    """Gapless ids along a total order, without one task for all rows.

    Rows are dealt into ranges of the order; a range's offset is the count of the ranges before. Ids are
    unique whatever columns are read later, as the ranges are fixed by a checkpoint.
    """
    return number(df, order, name, first)


def dense_id(df: DataFrame, key: Column, order: Sequence[str], name: str = "group_id", prefix: str = "") -> DataFrame:
    """Id of each key by first appearance along the order; a null key is a group of its own row."""
    row = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order])
    keyed = df.withColumn("_key", F.coalesce(F.concat(F.lit("K:"), key.cast("string")), F.concat(F.lit("R:"), row)))
    firsts = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    ids = sequential_id(firsts, ["_first", "_key"], "_id").select("_key", "_id")
    shown = F.concat(F.lit(prefix), F.col("_id").cast("string")) if prefix else F.col("_id")
    return keyed.join(ids, "_key").select(*df.columns, shown.alias(name))


def cross_arms(df: DataFrame, arms: Sequence[str], name: str = "arm") -> DataFrame:
    """Each row once for each arm; the arms are a literal list."""
    return df.select("*", F.explode(F.array(*[F.lit(a) for a in arms])).alias(name))


def repeat_rows(df: DataFrame, times: Column, name: str = "copy") -> DataFrame:
    return df.where(times >= 1).select("*", F.explode(F.sequence(F.lit(1), times)).alias(name))


def arms_to_rows(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str], label: str, value: str) -> DataFrame:
    """One row for each of the id columns, labelled."""
    long = df.unpivot(list(ids), list(columns), label, value)
    names = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    return long.withColumn(label, names[F.col(label)])


def pivot_difference(df: DataFrame, key: Sequence[str], arm: str, value: str, first: str, second: str, agg=F.avg) -> DataFrame:
    """The value of two arms side by side and first minus second."""
    wide = df.groupBy(*key).pivot(arm, [first, second]).agg(agg(value))
    return wide.withColumn("difference", F.col(f"`{first}`") - F.col(f"`{second}`"))


def display_name(parts: Sequence[Column], sep: str = ", ", fallback: Column | None = None) -> Column:
    """Non-blank parts joined; with none the fallback."""
    from plinth.functions.keys import null_if_blank

    joined = F.concat_ws(sep, *[null_if_blank(p) for p in parts])
    return F.when(joined != "", joined).otherwise(fallback if fallback is not None else F.lit(None).cast("string"))


def split_ordinal(c: Column) -> Column:
    """struct(ordinal, name) of `"1,270 | Name"`; no ordinal leaves the text as name."""
    pattern = r"^\s*([\d,]+)\s*\|\s*(.*)$"
    number = F.replace(F.regexp_extract(c, pattern, 1), F.lit(","), F.lit("")).try_cast("int")
    return F.struct(number.alias("ordinal"), F.when(number.isNotNull(), F.regexp_extract(c, pattern, 2)).otherwise(F.btrim(c)).alias("name"))


def mark_untrusted(df: DataFrame, columns: Sequence[str], prefix: str = "SIMULATED_") -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in columns if c in df.columns and not c.startswith(prefix)})
