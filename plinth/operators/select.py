"""Matching and conflict-free selection, as rounds of joins and bounded serial steps."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.lineage import cut
from plinth.operators.windows import seeded
from plinth.sources.io import ContractError


def greedy_match(edges: DataFrame, unit: str, candidate: str, cost: str, order: str, min_candidates: int = 1, block: Sequence[str] = (), chunk: int = 1000) -> DataFrame:
    """One-to-one matching without replacement: units in `order` take their cheapest free candidate.

    Equal to the serial loop, in two kinds of rounds:

    * a unit that is the first of all that list its cheapest free candidate takes it, all such units at once;
    * where that settles few (units that like the same candidates wait for each other), the first `chunk` units of
      each block are settled by the loop itself. Each needs its `chunk` cheapest free candidates only, as fewer than
      that can be taken before its turn, so a task gets at most chunk * chunk edges of a block.

    `block` names columns that edges never cross, such as state and gender; without any all units are one block.
    Ties of cost go to the lower candidate, ties of order to the lower unit. `min_candidates` is the number of
    candidates a unit needs to take part at all. Returns unit, candidate, cost.
    """
    own = F.struct(*[F.col(b).cast("string") for b in block]) if block else F.lit(0)
    e = edges.select(F.col(unit).alias("u"), F.col(candidate).alias("c"), F.col(cost).cast("double").alias("w"), F.col(order).alias("o"), F.xxhash64(own).alias("b"))
    e = e.dropna(subset=["u", "c", "w"]).groupBy("u", "c").agg(F.min("w").alias("w"), F.min("o").alias("o"), F.min("b").alias("b"))
    able = e.groupBy("u").agg(F.count("*").alias("n"), F.min("o").alias("o"), F.min("b").alias("b")).where(F.col("n") >= min_candidates)
    left = cut(e.drop("o", "b").join(able.drop("n"), "u"))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    done = left.limit(0).select("u", "c", "w")
    n_units = left.select("u").distinct().count()
    while n_units:
        best = left.groupBy("u").agg(F.min(F.struct("w", "c")).alias("p")).select("u", "p.*")
        lead = left.groupBy("c").agg(F.min(F.struct("o", "u")).alias("l")).select("c", F.col("l.u").alias("u"))
        new = cut(best.join(lead, ["u", "c"]))
        left, done = _without(left, new, new.select("u")), cut(done.unionByName(new.select("u", "c", "w")))
        before, n_units = n_units, left.select("u").distinct().count()
        if (before - n_units) * 8 < before:
            break
    while n_units:
        first = left.groupBy("b", "u").agg(F.min("o").alias("o")).withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy("o", "u"))).where(F.col("_r") <= chunk)
        near = left.join(first.select("u"), "u", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy("w", "c"))).where(F.col("_r") <= chunk)
        new = cut(near.select("b", "u", "c", "w", "o").groupBy("b").applyInPandas(_serial_match, f"u {kinds['u']}, c {kinds['c']}, w double"))
        left = _without(left, new, first.select("u"))
        done = cut(done.unionByName(new.where("c is not null")))
        n_units = left.select("u").distinct().count()
    return done.select(F.col("u").alias(unit), F.col("c").alias(candidate), F.col("w").alias(cost))


def _without(left: DataFrame, taken: DataFrame, settled: DataFrame) -> DataFrame:
    """Edges of units that are not settled to candidates that are not taken."""
    return cut(left.join(settled, "u", "left_anti").join(taken.where("c is not null").select("c"), "c", "left_anti").select("u", "c", "w", "o", "b"))


def _serial_match(pdf: pd.DataFrame) -> pd.DataFrame:
    """The loop over one block's first units; a unit whose candidates are all taken has a null one."""
    taken, out = set(), []
    for u, rows in pdf.sort_values(["o", "u", "w", "c"]).groupby("u", sort=False):
        free = next(((c, w) for c, w in zip(rows["c"].tolist(), rows["w"].tolist()) if c not in taken), None)
        if free:
            taken.add(free[0])
            out.append((u, *free))
    found = pd.DataFrame(out, columns=["u", "c", "w"])
    return found.astype({"u": pdf["u"].dtype, "c": pdf["c"].dtype}) if len(found) else found


def disjoint_selection(nodes: DataFrame, node: str, keys: str, rank: Sequence[str], cap: int, chunk: int = 20_000) -> DataFrame:
    """Nodes taken by rank unless they share a key with one taken before, at most `cap`.

    Returns node, status (selected, dropped_shares_key, not_needed), conflicts_with
    and self_collision (the node lists a key twice). The greedy choice is the first maximal
    independent set along the rank. Rounds of two kinds give it: a node that leads on all its
    keys is taken and those sharing a key with it go; where chains of conflicts leave most nodes open,
    the first `chunk` nodes by rank are settled by the serial loop in one task, until `cap` is reached.
    """
    base = nodes.select(F.col(node).alias("n"), F.struct(*rank, F.col(node).alias("_n")).alias("r"), F.array_compact(F.col(keys)).alias("all_keys"))
    base = base.withColumn("self_collision", F.size("all_keys") > F.size(F.array_distinct("all_keys")))
    base = cut(base.withColumn("ks", F.array_distinct("all_keys")).drop("all_keys"))
    open_ = base.select("n", "r", "ks")
    taken, n_open = open_.limit(0), open_.count()
    kind = base.schema["n"].dataType.simpleString()

    def settle(new: DataFrame, gone: DataFrame | None = None) -> None:
        nonlocal open_, taken, n_open
        new_keys = new.select(F.explode("ks").alias("k")).distinct()
        rest = open_.join((new if gone is None else gone).select("n"), "n", "left_anti")
        lost = rest.select("n", F.explode("ks").alias("k")).join(new_keys, "k", "left_semi").select("n").distinct()
        taken, open_ = cut(taken.unionByName(new.select("n", "r", "ks"))), cut(rest.join(lost, "n", "left_anti"))
        n_open = open_.count()

    while n_open:
        before = n_open
        long = open_.select("n", "r", F.explode("ks").alias("k"))
        lead = long.groupBy("k").agg(F.min("r").alias("m"))
        blocked = long.join(lead, "k").where("r > m").select("n").distinct()
        settle(cut(open_.join(blocked, "n", "left_anti")))
        if (before - n_open) * 8 < before:
            break
    while n_open:
        # Nodes up to `last` are all settled by now but for the open ones; enough of them end the search.
        last = open_.agg(F.min("r").alias("last"))
        if taken.crossJoin(F.broadcast(last)).where("r < last").count() >= cap:
            break
        first = cut(open_.orderBy("r").limit(chunk))
        chosen = cut(first.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_serial_selection, f"n {kind}"))
        settle(first.join(chosen, "n", "left_semi"), first)
    if taken.isEmpty():
        return base.select(F.col("n").alias(node), F.lit("selected").alias("status"), F.lit(None).cast("string").alias("conflicts_with"), "self_collision")
    # A conflict names the holder of the node's first key that was taken when its turn came.
    holders = taken.select(F.explode("ks").alias("k"), F.col("n").alias("holder"), F.col("r").alias("hr"))
    rejected = base.join(taken.select("n"), "n", "left_anti").select("n", "r", F.posexplode("ks").alias("i", "k"))
    dropped = rejected.join(holders, "k").where("hr < r").groupBy("n").agg(F.min_by("holder", "i").alias("conflicts_with"))
    chosen = cut(taken.select("n", "r").orderBy("r").limit(cap))
    full = chosen.count() >= cap
    last = chosen.agg(F.max("r").alias("last"))  # one row
    out = base.join(chosen.select("n", F.lit(True).alias("sel")), "n", "left").join(dropped, "n", "left").crossJoin(F.broadcast(last))
    beyond = (F.col("r") > F.col("last")) if full else F.lit(False)
    status = F.when(F.col("sel"), "selected").when(beyond, "not_needed").otherwise("dropped_shares_key")
    return out.select(F.col("n").alias(node), status.alias("status"), F.when(status == "dropped_shares_key", F.col("conflicts_with").cast("string")).alias("conflicts_with"), "self_collision")


def _serial_selection(pdf: pd.DataFrame) -> pd.DataFrame:
    """The greedy loop over nodes by rank."""
    held: set[object] = set()
    out = []
    ranks = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in pdf["r"]]
    for i in sorted(range(len(pdf)), key=ranks.__getitem__):
        keys = list(pdf["ks"].iat[i])
        if not held.intersection(keys):
            held.update(keys)
            out.append(pdf["n"].iat[i])
    return pd.DataFrame({"n": out}) if out else pd.DataFrame({"n": pdf["n"].iloc[:0]})


def _places(rows: DataFrame, group: Sequence[str], pair: str, name: str) -> DataFrame:
    """`rows` plus `name`, their place from 0 on by `_h` and pair in each group. Digests are even, so their first digits cut ranges and none is sampled."""
    cut_up = rows.withColumn("_range", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows of a group
    bases = cut_up.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_range").orderBy("_h", pair)
    return cut_up.withColumn("_in", F.row_number().over(within)).join(bases, [*group, "_range"]).withColumn(name, F.col("_base") + F.col("_in") - 1).drop("_h", "_range", "_base", "_in")


def blinded_slots(df: DataFrame, pair: str, arm: str, seed: int = 0, max_tries: int = 1000, tries_at_once: int = 8) -> DataFrame:
    """A slot 1..n for each row that tells nothing of its arm.

    Each arm has exactly half odd and half even slots, and no pair sits on
    neighbouring slots. Pairs are dealt half and half to two parities by a
    seeded order, and each parity's slots are given out by another; a seed whose
    slots put a pair side by side is tried again with the next salt (about one in
    seven keeps them apart, however many pairs there are). A pair's two slots do
    not hang on the deal, so several salts are tried in one job before it is made.
    """
    arms = sorted(r[0] for r in df.select(arm).distinct().limit(3).collect())
    sizes = df.groupBy(pair).agg(F.count("*").alias("n"), F.count_distinct(arm).alias("a"))
    n_pairs, bad = sizes.agg(F.count("*"), F.count_if(F.expr("n <> 2 or a <> 2"))).first()
    if len(arms) != 2 or bad or n_pairs % 2 or n_pairs < 4:
        raise ContractError("slots need two arms, one row each in an even number of at least four pairs")
    pairs = cut(df.select(pair).distinct().dropna())

    def halves(salts: Sequence[int]) -> DataFrame:
        """_salt, _odd, pair, slot."""
        rows = pairs.withColumn("_salt", F.explode(F.array(*map(F.lit, salts)))).withColumn("_odd", F.explode(F.array(F.lit(1), F.lit(0))))
        placed = _places(rows.withColumn("_h", seeded(seed, F.col("_salt"), F.col("_odd"), F.col(pair))), ["_salt", "_odd"], pair, "_k")
        return placed.withColumn("slot", F.col("_k") * 2 + 2 - F.col("_odd")).drop("_k")

    for first in range(0, max_tries, tries_at_once):
        salts = range(first, min(first + tries_at_once, max_tries))
        gaps = halves(salts).groupBy("_salt", pair).agg((F.max("slot") - F.min("slot")).alias("gap"))
        near = {r[0] for r in gaps.where("gap = 1").select("_salt").distinct().collect()}  # at most tries_at_once rows
        salt = next((s for s in salts if s not in near), None)
        if salt is not None:
            one = pairs.withColumn("_salt", F.lit(salt))
            dealt = _places(one.withColumn("_h", seeded(seed, F.col("_salt"), F.col(pair))), ["_salt"], pair, "_i").drop("_salt")
            rows = df.join(dealt, pair).withColumn("_odd", ((F.col("_i") % 2 == 0) == (F.col(arm) == arms[0])).cast("int"))
            return rows.join(halves([salt]).drop("_salt"), [pair, "_odd"]).select(*df.columns, "slot")
    raise ContractError("no seed keeps pairs apart")
