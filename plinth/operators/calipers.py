"""Greedy matching on a score within a caliper, without a list of pairs.

Units in order take the nearest free candidate of their block (ties: the lower
candidate), as the serial loop does. Units and candidates stand in one order of
block and score, which is cut into windows of consecutive rows; each window is
settled in one task by the loop itself, with pointers to the next free
candidate on both sides. What a window cannot know is left open: a candidate
that a unit beyond the window's edge can reach is uncertain, a unit that would
take an uncertain candidate, or has the edge nearer than any, waits and makes
the next certain candidate it could fall back on uncertain too. What is certain
is settled; what waits goes on to the next round, whose windows are shifted by
half. Windows grow when rounds settle little, up to one for all that is left,
so the result is whole and equal to the loop's. No round makes more rows than
there are units and candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators.lineage import cut
from plinth.operators.ranges import number, sum_before


class Free:
    """Places 0..n-1 of which some are gone, with the next one that is left on either side."""

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # `down` is shifted by one: 0 stands for none

    @staticmethod
    def _find(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    def at_or_after(self, i: int) -> int:
        return self._find(self.up, i)

    def at_or_before(self, i: int) -> int:
        return self._find(self.down, i + 1) - 1

    def remove(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i


def _nearest(free: Free, at: int, s: float, scores: list[float], starts: list[int], keys: list, caliper: float) -> tuple[float, object, int] | None:
    """(gap, key, place) of the nearest place left within the caliper; `at` is the first place whose score is not under s."""
    found = []
    right = free.at_or_after(at)
    if right < len(scores):
        found.append(right)
    left = free.at_or_before(at - 1)
    if left >= 0:
        found.append(free.at_or_after(starts[left]))  # of equal scores, the lowest key that is left
    near = [(abs(s - scores[i]), keys[i], i) for i in found if abs(s - scores[i]) < caliper]
    return min(near) if near else None


def settle(scores: list[float], keys: list, units: list[tuple], caliper: float, low: float | None, high: float | None) -> tuple[dict, list]:
    """({unit: (candidate place, gap) or None}, units that wait) of a part of a block.

    Candidates are in order of score and key; units are (order, key, score), in order. `low` and `high` are the scores
    at an open edge, beyond which there can be more of both.
    """
    n = len(scores)
    free, certain = Free(n), Free(n)
    for i, v in enumerate(scores):
        if (low is not None and v - low < caliper) or (high is not None and high - v < caliper):
            certain.remove(i)
    starts = np.searchsorted(scores, scores, side="left").tolist() if n else []
    places = np.searchsorted(scores, [u[2] for u in units], side="left").tolist() if units else []
    found, waiting = {}, []
    for (_, key, s), at in zip(units, places):
        edge = min([abs(s - e) for e in (low, high) if e is not None], default=np.inf)
        first, sure = (_nearest(f, at, s, scores, starts, keys, caliper) for f in (free, certain))
        if first is None and edge >= caliper:
            found[key] = None
        elif first is not None and sure is not None and first[2] == sure[2] and first[0] < edge:
            found[key] = (first[2], first[0])
            free.remove(first[2])
            certain.remove(first[2])
        else:
            waiting.append(key)
            if sure is not None:
                certain.remove(sure[2])
    return found, waiting


def greedy_caliper_match(units: DataFrame, candidates: DataFrame, block: Sequence[str], unit: str, unit_score: str, order: str, candidate: str, candidate_score: str, caliper: float, min_candidates: int = 1, window: int = 50_000) -> DataFrame:
    """unit, candidate, gap (absolute difference of scores, under `caliper`): one-to-one, without replacement.

    `block` are columns of both sides that must be equal; `min_candidates` is how many candidates of all a unit needs
    within the caliper (between score - caliper and score + caliper as doubles) to take part. Rows with a null block,
    key, score or order take no part; of repeated keys the least row counts. Ties of order go to the lower unit.
    """
    b = F.to_json(F.struct(*block)) if len(block) > 1 else F.col(block[0]).cast("string") if block else F.lit("")
    u = units.dropna(subset=[*block, unit, unit_score, order]).select(b.alias("b"), F.col(unit_score).cast("double").alias("s"), F.col(unit).alias("u"), F.col(order).alias("o"))
    c = candidates.dropna(subset=[*block, candidate, candidate_score]).select(b.alias("b"), F.col(candidate_score).cast("double").alias("s"), F.col(candidate).alias("c"))
    u = u.groupBy("u").agg(F.min(F.struct("o", "b", "s")).alias("_r")).select("_r.b", "_r.s", "u", "_r.o")
    c = c.groupBy("c").agg(F.min(F.struct("b", "s")).alias("_r")).select("_r.b", "_r.s", "c")
    if min_candidates > 1:
        u = _with_enough(u, c, caliper, min_candidates)
    rows = cut(u.select("b", "s", F.lit(1).alias("side"), "u", "o", F.lit(None).cast(c.schema["c"].dataType).alias("c")).unionByName(c.select("b", "s", F.lit(0).alias("side"), F.lit(None).cast(u.schema["u"].dataType).alias("u"), F.lit(None).cast(u.schema["o"].dataType).alias("o"), "c")))
    fields = [T.StructField("window", T.LongType()), *rows.schema.fields, T.StructField("got", rows.schema["c"].dataType), T.StructField("gap", T.DoubleType()), T.StructField("state", T.IntegerType())]
    schema, done, shift = T.StructType(fields), None, 0
    left = rows.where("side = 1").count()
    total = rows.count()
    while left:
        placed = number(rows, ["b", "s", "side", "c", "u"], "pos")
        parted = placed.withColumn("window", F.expr(f"(pos + {shift * (window // 2)}) div {window}"))
        last = (total - 1 + shift * (window // 2)) // window
        out = cut(parted.groupBy("window").applyInArrow(_settler(caliper, last, schema), schema))
        new = out.where("got is not null").select("u", F.col("got").alias("c"), "gap")
        done = new if done is None else done.unionByName(new)
        rows = out.where("state = 0").select(*rows.columns)
        before, (left, total) = left, rows.agg(F.count_if(F.col("side") == 1), F.count("*")).first()
        shift = 1 - shift
        if (before - left) * 4 < before:
            window *= 4
    empty = u.limit(0).crossJoin(c.limit(0).select("c")).select("u", "c", F.lit(0.0).alias("gap"))
    return (done if done is not None else empty).select(F.col("u").alias(unit), F.col("c").alias(candidate), "gap")


def _with_enough(u: DataFrame, c: DataFrame, caliper: float, least: int) -> DataFrame:
    """Units with at least `least` candidates within the caliper, by counts of candidates before both ends."""
    kind = u.schema["u"].dataType
    ends = [u.select("b", (F.col("s") + sign * caliper).alias("v"), F.lit(-sign).alias("side"), "u", F.lit(0).alias("is_c")) for sign in (-1, 1)]
    marks = c.select("b", F.col("s").alias("v"), F.lit(0).alias("side"), F.lit(None).cast(kind).alias("u"), F.lit(1).alias("is_c"))
    summed = sum_before(marks.unionByName(ends[0]).unionByName(ends[1]), ["b", "v", "side", "u"], "is_c", "n").where("u is not null")
    enough = summed.groupBy("u").agg((F.max("n") - F.min("n")).alias("n")).where(F.col("n") >= least).select("u")
    return u.join(enough, "u", "left_semi").select("b", "s", "u", "o")


def _settler(caliper: float, last: int, schema: T.StructType) -> Callable[[pa.Table], pa.Table]:
    return lambda found: _window(found, caliper, last, schema)


def _window(found: pa.Table, caliper: float, last: int, schema: T.StructType) -> pa.Table:
    """A window's rows with what each unit got; state 0: goes on, 1: settled (or a candidate that is taken)."""
    d = {name: found[name].to_pylist() for name in ("pos", "window", "b", "s", "side", "u", "o", "c")}
    n, number_of = len(d["pos"]), d["window"][0]
    order = sorted(range(n), key=d["pos"].__getitem__)
    got, gap, state = [None] * n, [None] * n, [0] * n
    at = 0
    while at < n:
        to = at
        while to < n and d["b"][order[to]] == d["b"][order[at]]:
            to += 1
        part = order[at:to]
        low = d["s"][part[0]] if at == 0 and number_of > 0 else None
        high = d["s"][part[-1]] if to == n and number_of < last else None
        offered = sorted((i for i in part if d["side"][i] == 0), key=lambda i: (d["s"][i], d["c"][i]))
        asking = sorted((i for i in part if d["side"][i] == 1), key=lambda i: (d["o"][i], d["u"][i]))
        by_key = {d["u"][i]: i for i in asking}
        settled, _ = settle([d["s"][i] for i in offered], [d["c"][i] for i in offered], [(d["o"][i], d["u"][i], d["s"][i]) for i in asking], caliper, low, high)
        for key, hit in settled.items():
            i = by_key[key]
            state[i] = 1
            if hit is not None:
                got[i], gap[i] = d["c"][offered[hit[0]]], hit[1]
                state[offered[hit[0]]] = 1
        at = to
    kept = [found[name].combine_chunks() for name in ("window", "b", "s", "side", "u", "o", "c")]
    return pa.table([*kept, pa.array(got, kept[-1].type), pa.array(gap, pa.float64()), pa.array(state, pa.int32())], names=schema.names)
