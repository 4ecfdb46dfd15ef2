"""Joins with declared cardinality and coverage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.ranges import around
from plinth.sources.io import ContractError

KeyFun = Callable[[Column], Column]

#: Tasks that share the rows of one key in `either_key`.
PARTS_OF_A_KEY = 8

#: Rows of a part in `dealt`.
ROWS_OF_A_PART = 250_000


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has; null keys never join and don't count."""
    known = df.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "right side") -> None:
    bad = duplicate_keys(df, keys).limit(3).collect()
    if bad:
        raise ContractError(f"{what} has repeated keys {list(keys)}: {[tuple(r) for r in bad]}")


def join_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: n_left, n_matched, coverage, n_right_keys, n_repeated_keys and growth (rows of a left join for each left row)."""
    sizes = right.dropna(subset=list(on)).groupBy(*on).agg(F.count("*").alias("_n"))
    keys = sizes.agg(F.count("*").alias("n_right_keys"), F.count_if(F.col("_n") > 1).alias("n_repeated_keys"))
    hits = left.join(sizes, list(on), "left").agg(F.count("*").alias("n_left"), F.count("_n").alias("n_matched"), F.coalesce(F.sum(F.coalesce("_n", F.lit(1))), F.lit(0)).alias("_out"))
    both = hits.crossJoin(F.broadcast(keys))  # one row each
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(1.0))
    return both.select("n_left", "n_matched", share("n_matched", "n_left").alias("coverage"), "n_right_keys", "n_repeated_keys", share("_out", "n_left").alias("growth"))


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` dealt by keys into as many parts as its rows need, so that a task's memory does not grow with the table; groups and joins on the keys keep the parts."""
    parts = max(-(-df.count() // ROWS_OF_A_PART), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", min_coverage: float = 0.0, unique: bool = True, max_growth: float | None = None) -> DataFrame:
    """A join whose right side must be unique on its keys and cover a share of the left rows.

    With `unique` off, `max_growth` is the ceiling on rows out for each left row.
    """
    if unique and how not in ("left_semi", "left_anti"):
        assert_unique(right, on)
    if min_coverage > 0 or max_growth is not None:
        found = join_report(left, right, on).first()
        if found.coverage < min_coverage:
            raise ContractError(f"only {found.coverage:.1%} of rows find a match, {min_coverage:.1%} needed")
        if max_growth is not None and found.growth > max_growth:
            raise ContractError(f"the join makes {found.growth:.2f} rows of each, {max_growth:.2f} allowed")
    return left.join(right, list(on), how)


def keyed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, key_fun: KeyFun, values: Sequence[str], order: Sequence[str], min_coverage: float = 0.0) -> DataFrame:
    """Left join on normalised keys; of equal right keys the first along `order` counts."""
    r = keep_first(right.withColumn("_key", key_fun(F.col(right_key))).where("_key is not null"), ["_key"], order)
    l = left.withColumn("_key", key_fun(F.col(left_key)))
    return safe_join(l, r.select("_key", *values), ["_key"], "left", min_coverage, unique=False).drop("_key")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first along a total order, by a partial aggregate; nulls of the order sort first."""
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(rest, F.struct(*sort)).alias("_row"))
    return best.select("_row.*")


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], required: bool = False) -> DataFrame:
    """Lookup of the first right row by key; `required` makes a missing one an error when the row is computed."""
    hits = keep_first(right, keys, order).select(*keys, *values).withColumn("_hit", F.lit(True))
    out = left.join(hits, list(keys), "left")
    if required:
        missing = F.raise_error(F.concat(F.lit("no match for "), F.to_json(F.struct(*keys)))).cast("boolean")
        out = out.where(F.coalesce(F.col("_hit"), missing))
    return out.drop("_hit")


def cascade(left: DataFrame, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]], value: str, default: str | None = None, via: str = "match_via") -> DataFrame:
    """Value of the first tier (label, table, keys) that has it, and the tier's label.

    Each tier's table must be unique on its keys. A default is labelled `rule`.
    """
    out, found, label = left, [], F.lit(None).cast("string")
    for i, (name, table, keys) in enumerate(tiers):
        assert_unique(table, keys, f"tier {name}")
        out = out.join(table.select(*keys, F.col(value).alias(f"_v{i}")), list(keys), "left")
        found.append(F.col(f"_v{i}"))
    for i, (name, _, _) in reversed(list(enumerate(tiers))):
        label = F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)).otherwise(label)
    if default is not None:
        label = F.coalesce(label, F.lit("rule"))
        found.append(F.lit(default))
    return out.select(*left.columns, F.coalesce(*found).alias(value), label.alias(via))


def unique_or_ambiguous(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value where one distinct one fits; `status` is unique, ambiguous or unmatched."""
    hits = right.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"))
    out = left.join(hits, list(keys), "left")
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "unmatched").when(n == 1, "unique").otherwise("ambiguous")
    return out.select(*left.columns, F.when(n == 1, F.col("_v")).alias(value), status.alias("status"))


def lookup_join(left: DataFrame, table: DataFrame, key: str, value: str, default: str | None = None, most_rows: int = 100_000) -> DataFrame:
    """Small lookup, broadcast only if it has at most `most_rows` rows; without a default an unknown key is an error."""
    assert_unique(table, [key], "lookup")
    small = table.select(key, value)
    small = F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small
    out = left.join(small, key, "left")
    stop = F.raise_error(F.concat(F.lit(f"{key} has no {value}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(table.schema[value].dataType)
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(default) if default is not None else stop))


def either_key(left: DataFrame, right: DataFrame, alternatives: Sequence[Sequence[str]], left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) pairs that agree on all keys of at least one alternative.

    One equi-join for each alternative, then a union; an OR-condition would be a nested loop. A pair counts for the
    first alternative that it agrees on, so where ids are unique no pair comes twice, and pairs, of which there can be
    many more than rows, are neither shuffled nor held. The rows of a key are dealt to several tasks.
    """
    named = lambda df, i, k: df.select(F.col(i).alias(f"{k}_id"), *[F.col(c).alias(f"_{k}_{c}") for c in dict.fromkeys(c for a in alternatives for c in a)])
    l, r = named(left, left_id, "left"), named(right, right_id, "right")
    repeated = any(not duplicate_ids(df, c).isEmpty() for df, c in ((l, "left_id"), (r, "right_id")))

    def agree(keys: Sequence[str]) -> Column:
        both = F.lit(True)
        for k in keys:
            both &= F.col(f"_left_{k}") == F.col(f"_right_{k}")
        return both

    out, parts = None, F.lit(PARTS_OF_A_KEY)
    l = l.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "left_id")  # a small file is one task otherwise, whatever its pairs
    for n, keys in enumerate(alternatives):
        mine = l.dropna(subset=[f"_left_{k}" for k in keys]).withColumn("_deal", F.pmod(F.xxhash64("left_id"), parts))
        theirs = r.dropna(subset=[f"_right_{k}" for k in keys]).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        condition = agree(keys) & (F.col("_deal") == F.col("_part"))
        for before in alternatives[:n]:
            condition &= ~F.coalesce(agree(before), F.lit(False))
        pairs = mine.join(theirs, condition).select("left_id", "right_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct() if repeated else out


def duplicate_ids(df: DataFrame, name: str) -> DataFrame:
    """Values, null included, that more than one row has."""
    return df.groupBy(name).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def best_candidate(pairs: DataFrame, key: Sequence[str], score: Column, tiebreak: Sequence[str]) -> DataFrame:
    """The least-score candidate of each key; ties by `tiebreak`."""
    scored = pairs.withColumn("score", score)
    return keep_first(scored, key, ["score", *tiebreak])


def best_by_gap(left: DataFrame, right: DataFrame, block: Sequence[str], left_key: str, left_score: str, right_key: str, right_score: str) -> DataFrame:
    """left_key, right_key, gap: `best_candidate` of all pairs of a block by the difference of their scores, without the pairs.

    Ties go to the lower right key. A pair with an unknown score has a null gap and comes after all others; keys of
    the left side can repeat. Rows with a null block, and blocks without a row of `right`, give nothing.
    """
    own = left.select(*block, left_key, left_score).dropna(subset=list(block)).distinct()
    rows = own.withColumn("_row", F.struct(*own.columns))
    offered = right.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(block)], F.col(right_key).alias("_k"), F.col(right_score).alias("_v"))
    named = offered.select(*[F.col(f"_o{i}").alias(c) for i, c in enumerate(block)], "_k", "_v")
    near = nearest(rows, named, block, "_row", left_score, "_k", "_v").drop("_row")
    first = named.dropna(subset=list(block)).groupBy(*block).agg(F.min("_k").alias("_first"))
    gap = F.abs(F.col(left_score) - F.col("_v"))
    found = near.join(first, list(block)).select(F.col(left_key), F.struct(gap.isNull().alias("unknown"), gap.alias("gap"), F.coalesce("_k", "_first").alias("k")).alias("_best"))
    best = found.groupBy(left_key).agg(F.min("_best").alias("_best"))
    return best.select(left_key, F.col("_best.k").alias(right_key), F.col("_best.gap").alias("gap"))


def backup_score(gender: tuple[Column, Column], credential: tuple[Column, Column], years: tuple[Column, Column]) -> Column:
    """2 for each of gender and credential that differs, 0.1 for each year between; unknown years count as 15."""
    differs = lambda a, b: F.when(a.eqNullSafe(b), 0.0).otherwise(2.0)
    gap = F.abs(F.coalesce(years[0], F.lit(15)) - F.coalesce(years[1], F.lit(15)))
    return differs(*gender) + differs(*credential) + 0.1 * gap


def pair_members(df: DataFrame, pair: str, arm: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """The two members of each pair in one row, with suffixes _1 and _2."""
    a = df.where(F.col(arm) == first).select(pair, *[F.col(c).alias(f"{c}_1") for c in columns])
    b = df.where(F.col(arm) == second).select(pair, *[F.col(c).alias(f"{c}_2") for c in columns])
    return a.join(b, pair)


def best_hit(df: DataFrame, hits: str, score: Callable[[Column], Column], usable: Callable[[Column], Column]) -> Column:
    """The usable element of a nested array with the highest score, the first on ties; null without any."""
    scored = F.transform(F.filter(hits, usable), lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("hit")))
    return F.array_min(scored)["hit"]


def key_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    only = lambda p, q, n: p.join(q, list(keys), "left_anti").withColumn("only_in", F.lit(n))
    return only(x, y, names[0]).unionByName(only(y, x, names[1]))


def disagreements(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Rows with one key on both sides whose columns (left name to right name) differ."""
    r = b.select(*key, *[F.col(v).alias(f"_r_{v}") for v in columns.values()])
    joined = a.select(*key, *columns).join(r, list(key))
    differs = F.lit(False)
    for mine, theirs in columns.items():
        differs = differs | ~F.col(mine).eqNullSafe(F.col(f"_r_{theirs}"))
    return joined.where(differs)


def with_fallback(left: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str, value: str, labels: tuple[str, str]) -> DataFrame:
    """Value of the first table, else of the second, and which one it was."""
    a = first.select(first_key, F.col(value).alias("_a"))
    b = second.select(second_key, F.col(value).alias("_b"))
    out = left.join(a, first_key, "left").join(b, second_key, "left")
    method = F.when(F.col("_a").isNotNull(), labels[0]).when(F.col("_b").isNotNull(), labels[1])
    return out.select(*left.columns, F.coalesce("_a", "_b").alias(value), method.alias("method"))


def fill_where_blank(left: DataFrame, table: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """`column` from the lookup's `source` only where it is blank."""
    from plinth.functions.keys import null_if_blank

    got = table.select(key, F.col(source).alias("_fill"))
    return left.join(got, key, "left").withColumn(column, F.coalesce(null_if_blank(F.col(column)), F.col("_fill"))).drop("_fill")


def window_count(df: DataFrame, keys: Sequence[str], name: str = "n_rows") -> DataFrame:
    """The size of each row's group beside the row."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))


def nearest(left: DataFrame, right: DataFrame, block: Sequence[str], left_key: str, left_score: str, right_key: str, right_score: str) -> DataFrame:
    """`left` plus the key and score of the nearest row of `right` in its block; ties go to the smaller key.

    An as-of join in both directions: rows of both sides are put in one order of block and score, written in ranges,
    and each row looks at its neighbours; no pair is made, and a block of any size is cut into ranges. Scores of one
    block that differ by less than rounding may tie either way. Rows with a null score or block, and blocks without a
    row of `right`, find nothing (null key and score).
    """
    b = [f"_b{i}" for i in range(len(block))]
    names = lambda df: [F.col(f"`{c}`").alias(x) for c, x in zip(block, b)]
    offered = right.select(*names(right), F.col(right_score).cast("double").alias("_s"), F.col(right_key).alias("_k")).dropna().groupBy(*b, "_s").agg(F.min("_k").alias("_k"))
    asked = left.select(*names(left), F.col(left_score).cast("double").alias("_s"), F.col(left_key).alias("_l")).dropna()
    kinds = {f.name: f.dataType for f in [*offered.schema.fields, *asked.schema.fields]}
    rows = offered.select(*b, "_s", F.lit(0).alias("_side"), F.lit(None).cast(kinds["_l"]).alias("_l"), "_k").unionByName(asked.select(*b, "_s", F.lit(1).alias("_side"), "_l", F.lit(None).cast(kinds["_k"]).alias("_k")))
    value = F.when(F.col("_side") == 0, F.struct(*b, "_s", "_k"))
    seen = around(rows, [*b, "_s", "_side", "_l", "_k"], value, "_before", "_after").where("_side = 1")

    def candidate(side: str) -> Column:
        same = F.lit(True)
        for c in b:
            same &= F.col(f"{side}.{c}") == F.col(c)
        gap = F.abs(F.col("_s") - F.col(f"{side}._s"))
        return F.when(same, F.struct(gap.alias("gap"), F.col(f"{side}._k").alias("k"), F.col(f"{side}._s").alias("s")))

    found = seen.select("_l", F.array_min(F.array_compact(F.array(candidate("_before"), candidate("_after")))).alias("_near"))
    near = found.groupBy("_l").agg(F.min("_near").alias("_near")).select(F.col("_l").alias(left_key), F.col("_near.k").alias(right_key), F.col("_near.s").alias(right_score))
    return left.join(near, left_key, "left")
