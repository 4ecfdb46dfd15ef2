"""Sharding by longest-processing-time scheduling; groups of equal texts stay together.

The heap only ever sees a bounded number of items. A group of at least
1/(shards * bundles) of all bytes is an item of its own (there can be at most
shards * bundles of these); smaller groups are merged by hash into at most
shards * bundles bundles. Items, longest first, go to the least-loaded shard,
so that the fullest shard is over the mean by less than the largest item, and a
bundle is about 1/(shards * bundles) of all bytes or less.

Null and empty texts are one group. Repeated doc_ids are separate rows.
An empty table gives an empty result. Extra columns pass through unless they
clash with an output column, which then replaces them.

Slots follow a hash order of a shard's rows, or, with `place`, the `position`
that it adds to the rows: unique integers of at least 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import cut, number_rows

OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Positions in one bucket of the numbering by position, so at most as many rows.
POSITIONS = 4096


def longest_first(items: pd.DataFrame, shards: int) -> pd.DataFrame:
    """LPT: items (item, bytes), longest first, to the least-loaded shard."""
    ordered = items.sort_values(["bytes", "item"], ascending=[False, True])
    heap = [(0, s) for s in range(shards)]
    placed = []
    for size in ordered["bytes"]:
        load, shard = heapq.heappop(heap)
        placed.append(shard)
        heapq.heappush(heap, (load + int(size), shard))
    return pd.DataFrame({"item": ordered["item"].to_numpy(), "shard": pd.Series(placed, dtype="int32").to_numpy()})


def shard(docs: DataFrame, shards: int = 24, bundles: int = 256, id_col: str = "doc_id", text_col: str = "text", place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`docs` without `text_col`, with size, text_crc32, law, shard, slot and grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c != text_col and c.lower() not in OUTPUT]
    # Three readers follow; the rows without texts are kept once.
    rows = docs.select(
        *kept,
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("_group"),
    )
    rows = cut(place(rows) if place else rows)
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    total = groups.agg(F.sum("_bytes").alias("_total"))
    limit = shards * bundles
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("_group"), F.lit(limit)).cast("string"))
    is_large = F.col("_bytes") * limit >= F.col("_total")
    # One row of totals: the cross join adds a scalar.
    item_of = groups.crossJoin(F.broadcast(total)).select(
        "_group", "_bytes", F.when(is_large, F.col("_group")).otherwise(bundle).alias("item")
    )
    items = item_of.groupBy("item").agg(F.sum("_bytes").alias("bytes"))
    # At most 2 * shards * bundles rows reach this one task, whatever the input.
    plan = items.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: longest_first(pdf, shards), "item string, shard int")
    placed = rows.join(item_of.join(plan, "item").select("_group", "shard"), "_group").drop("_group")
    if place:
        out = number_rows(placed, ["shard"], [F.col("position")], "slot", bucket=F.expr(f"position div {POSITIONS}"))
    else:
        out = number_rows(placed, ["shard"], [F.col("text_crc32"), F.col("size"), F.col(id_col)], "slot", spread=1024)
    return out.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def balance(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
