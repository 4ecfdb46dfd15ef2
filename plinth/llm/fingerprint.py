"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct shingle hashes (48 bits each) of a text,
and whether that is all of them. Sketches of parts merge into the sketch of
the whole. Resemblance is read from the k smallest hashes of the union,
containment from resemblance and the distinct counts, and the distinct count
from the k-th smallest hash. Texts with at most k shingles are exact.

A null text counts as empty; the fingerprint of a text without words is
empty, and two such fingerprints are alike (1.0). Equal texts have equal
fingerprints. Repeated ids are separate rows in any order among themselves.
Texts of any length are gone through whole; columns other than id and text are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shingles import shingle_sets

K, BITS = 256, 48


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted smallest hashes; one more than k would be kept only to tell that there are more."""
    small = np.unique(shingles >> np.uint64(64 - BITS))
    return small[: k + 1] if len(small) > k else small


def pack(values: np.ndarray) -> str:
    raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return base64.b64encode(raw.tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[: k + 1]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) <= k else (k - 1) * float(1 << BITS) / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:k]
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    return float(both.sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct(a, k) + distinct(b, k))
    return min(1.0, shared / distinct(a, k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """`id_col`, fingerprint and distinct_shingles (estimated) of each row."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(s, k) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x) for x in made], pa.string()), pa.array([distinct(x, k) for x in made])], names=[id_col, "fingerprint", "distinct_shingles"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, fingerprint string, distinct_shingles double")


def merge_fingerprints(sketched: DataFrame, keys: list[str], k: int = K, salt: int = 32) -> DataFrame:
    """One fingerprint for each value of `keys`, merged in two steps so that a hot key is spread."""

    def union(values: pd.Series) -> str:
        whole = np.zeros(0, np.uint64)
        for x in values:
            whole = merge(whole, unpack(x), k)
        return pack(whole)

    merged = F.pandas_udf(union, "string")
    salted = sketched.withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salt)))
    parts = salted.groupBy(*keys, "_salt").agg(merged("fingerprint").alias("fingerprint"))
    return parts.groupBy(*keys).agg(merged("fingerprint").alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows_each: int = 1500) -> DataFrame:
    """Fingerprint each text and an edit of it that ends with the next text's beginning.

    The edited text has the last floor(n_chars / 2) code points replaced by as
    many first ones of the next document in ascending id order (after the
    last: the first); a null id counts as the lowest. Rows are dealt into id
    ranges found from the ids alone, and each range also gets the row that
    follows it, so a sorted stream over a range sees every neighbour. Texts
    move once. Gathered: two ids for each of at most 20,000 ranges; beyond that
    ranges grow, which costs no memory, as a range is sorted with spills and
    streamed a batch at a time.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ids = rows.select("_id")
    parts = max(1, min(20_000, ids.count() // rows_each))
    bounds = np.array(sorted({int(x) for x in ids.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else [], np.int64)

    @F.pandas_udf("int")
    def part_of(column: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, column.to_numpy(), side="right").astype("int32"))

    found = ids.groupBy(part_of("_id").alias("_part")).agg(F.min("_id").alias("_id")).collect()
    firsts = sorted((r["_part"], r["_id"]) for r in found)
    goes_to = {first: firsts[j - 1][0] for j, (_, first) in enumerate(firsts)}  # j = 0: after the last comes the first

    @F.pandas_udf("array<int>")
    def parts_of(column: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, column.to_numpy(), side="right")
        return pd.Series([[int(p)] if (before := goes_to.get(x)) is None else [int(p), -before - 1] for x, p in zip(column.tolist(), own)])

    dealt = rows.withColumn("_to", F.explode(parts_of("_id"))).select(
        F.when(F.col("_to") < 0, -F.col("_to") - 1).otherwise(F.col("_to")).alias("_part"), (F.col("_to") < 0).alias("_ghost"), "_id", "_text"
    )
    dealt = dealt.repartition(max(1, len(firsts)), "_part").sortWithinPartitions("_part", "_ghost", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, id, text, sketch of the row that waits for its next one
        for batch in batches:
            whole = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), shingle_sets(batch.column(3)))
            done: list[tuple] = []
            for part, ghost, own, text, shingles in whole:
                now = sketch(shingles, k)
                if held is not None and held[0] == part:
                    n = len(held[2])
                    done.append((held[1], n, held[2][: n - n // 2] + text[: n // 2], held[3], now))
                    held = None
                if ghost:
                    held = None
                else:
                    held = (part, own, text, now)
            edits = [x[2] for x in done]
            changed = [sketch(s, k) for s in shingle_sets(pa.array(edits, pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in done], pa.int64()),
                    pa.array([x[1] for x in done], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                    pa.array([pack(x[3]) for x in done], pa.string()),
                    pa.array([pack(x) for x in changed], pa.string()),
                    pa.array([resemblance(x[3], y, k) for x, y in zip(done, changed)], pa.float64()),
                    pa.array([resemblance(x[3], x[4], k) for x in done], pa.float64()),
                    pa.array([distinct(x[3], k) for x in done], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles"],
            )

    out = dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
