"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks of `block` rows. With weight w, block
j of a source is released at floor(j / w) and due at ceil((j + 1) / w), counted
in blocks of the mixture. Earliest deadline first fills the slots; at any slot
t a source has had more than w*t - 1 and fewer than w*t + 1 blocks while all
sources last.

Weights are rounded to c/period with integers c >= 1 (largest remainder), so
the schedule repeats after `period` slots: it is computed once over a bounded
number of slots and every row finds its slot by arithmetic. The period is at
least four slots for each source. Deviations are measured against the rounded
weights, which differ from the targets by less than one slot of a period.

Every row is placed exactly once. When a source is used up, its later slots
stay empty and the others go on in schedule order; `in_mix` marks the slots
before that happens. A null source is a source of its own. Sources without a
given weight, weights of zero or less, and more than MOST_SOURCES sources are
an error; extra columns pass through. Empty tables give
empty results. Ties in the order of rows are broken by a hash of the id.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import number_rows


#: The schedule is made on the driver, so sources are bounded; many small ones (hosts, say) are grouped before.
MOST_SOURCES = 100_000


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integer slots for each source, at least one, summing to `period`."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    counts = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (counts[s] - exact[s], s))
    spare = period - sum(counts.values())
    for s in by_rest[: max(0, spare)]:
        counts[s] += 1
    while spare < 0:  # many sources were raised to one slot; take from the most over-served
        s = max((s for s in counts if counts[s] > 1), key=lambda s: (counts[s] - exact[s], s))
        counts[s] -= 1
        spare += 1
    return counts


def schedule(counts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block within the period, slot) by earliest deadline first."""
    period = sum(counts.values())
    release: list[list[tuple[int, int, str, int]]] = [[] for _ in range(period)]
    for s, c in counts.items():
        for j in range(c):
            due = -((-(j + 1) * period) // c)
            # Pfair's tie-break: a block whose window overlaps the next one's goes first.
            overlaps = 0 if (j + 1) * period % c else 1
            release[j * period // c].append((due, overlaps, s, j))
    ready: list[tuple[int, int, str, int]] = []
    placed = []
    for slot in range(period):
        for job in release[slot]:
            heapq.heappush(ready, job)
        due, _, s, j = heapq.heappop(ready)
        if due <= slot:
            raise RuntimeError("a block missed its deadline")
        placed.append((s, j, slot))
    return placed


def tempered(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str, float]:
    """Target weights n ** power of the sources, normalised; one row for each source is gathered, of MOST_SOURCES at most."""
    rows = docs.groupBy(source_col).count().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    total = sum(r["count"] ** power for r in rows) or 1.0
    return {_name(r[0]): r["count"] ** power / total for r in rows}


def _name(source: str | None) -> str:
    return "\x00null" if source is None else str(source)


def mix(docs: DataFrame, weights: dict[str, float], block: int = 16, period: int = 10_000, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs` plus mix_block, mix_slot, mix_position (order of the mixture) and in_mix."""
    spark = docs.sparkSession
    if len(weights) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    added = {"mix_block", "mix_slot", "mix_position", "in_mix"}
    rows = docs.select(*[c for c in docs.columns if c.lower() not in added])
    rows = rows.withColumn("_source", F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null")))
    counts = quotas({_name(s): w for s, w in weights.items()}, max(period, 4 * len(weights))) if weights else {}
    length = sum(counts.values())
    slots = pd.DataFrame(schedule(counts) if counts else [], columns=["_source", "_j", "_slot"])
    slots = slots.assign(_c=slots["_source"].map(counts)).astype({"_j": "int64", "_slot": "int64", "_c": "int64"})
    # One row for each slot of a period: bounded by the parameter.
    plan = spark.createDataFrame(slots, "_source string, _j long, _slot long, _c long")
    quota = plan.groupBy("_source").agg(F.max("_c").alias("_c"))
    ranked = number_rows(rows, ["_source"], [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)], "_rank", spread=512)
    blocks = ranked.join(F.broadcast(quota), "_source", "left")
    blocks = blocks.withColumn("mix_block", F.expr(f"_rank div {block}"))
    missing = F.raise_error(F.concat(F.lit("no weight for source "), F.col("_source")))
    blocks = blocks.withColumn("_c", F.coalesce(F.col("_c"), missing.cast("long")))
    blocks = blocks.withColumn("_j", F.expr("mix_block % _c")).withColumn("_turn", F.expr("mix_block div _c"))
    out = blocks.join(F.broadcast(plan.drop("_c")), ["_source", "_j"])
    out = out.withColumn("mix_slot", F.col("_turn") * length + F.col("_slot"))
    # The first source to run out ends the exact mixture: one row for each source.
    horizon = out.groupBy("_source").agg(F.max("mix_slot").alias("_last")).agg(F.min("_last").alias("_horizon"))
    out = out.crossJoin(F.broadcast(horizon)).withColumn("in_mix", F.col("mix_slot") <= F.col("_horizon"))
    out = out.withColumn("mix_position", F.col("mix_slot") * block + F.expr(f"_rank % {block}"))
    return out.select(*rows.columns[:-1], "mix_block", "mix_slot", "mix_position", "in_mix")
