"""Centroid clustering of vectors by k-means with Elkan's bounds, exact on integers.

Components become integers floor(scale * x), so distances are exact and every
result is the same on any number of partitions. Each vector carries an upper
bound of the distance to its own centroid and a lower bound for each of the k
centroids from round to round. A distance is computed only where neither a
lower bound nor half the distance between two centroids rules it out. Bounds
are floats rounded outward and rule out only what is strictly farther, so ties
are decided by exact distances: the smaller number wins.

A round is one pass in Arrow tasks that writes the vectors with their new
bounds to the shared folder (the table before it is deleted), and one
aggregate of k rows that moves the centroids. Only k centroids reach the driver.

Kept are vectors of exactly `dims` components, none null or not finite; others
are left out. Null and repeated ids are rows like any other (a null id is
hashed as an empty text); repeated vectors are assigned alike; ties between
equal hashes go to the smaller vector. With fewer than k kept vectors each is
a centroid; without any the result is empty. Centroids that no vector is
nearest to stay where they are. Other columns of the table are not read.
Components whose squared distances could exceed a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import cut, remove_table, write_table


def usable(vector: Column, dims: int | None = None) -> Column:
    """True for a vector without null, NaN or infinite components (and of `dims` of them)."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    sized = F.size(vector) == dims if dims is not None else F.lit(True)
    return F.coalesce(vector.isNotNull() & sized & finite, F.lit(False))


def quantised(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * component) + offset as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column of equal lengths as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def outward(values: np.ndarray, up: bool) -> np.ndarray:
    """float32 bounds, at least half a unit of float32 beyond `values`: more than any rounding before."""
    return np.nextafter(values.astype(np.float32), np.float32(np.inf if up else -np.inf))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one centroid or to a centroid for each row."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    most = reach * reach * x.shape[1]
    if most >= 1 << 63:
        raise OverflowError("squared distances do not fit into a long; use a smaller scale")
    if most < 1 << 53:  # every partial sum is an integer that a double holds
        gap = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


class Pass:
    """What an assignment needs to know of the centroids, and how far they moved since the last one."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None):
        k = len(centres)
        self.centres = centres
        gaps = np.stack([np.sqrt(squared(centres, c)) for c in centres]) * (1 - 1e-15)
        self.half = gaps / 2
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1)
        self.moved = None if before is None else np.sqrt(squared(centres, before)) * (1 + 1e-15)
        self.k = k

    def assign(self, x: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower, distances computed) of rows, given their state of the pass before."""
        n, done = len(x), 0
        if cluster is None:
            cluster, lower = np.zeros(n, np.int64), np.zeros((n, self.k), np.float32)
            unsure = np.ones(n, bool)
            upper = np.full(n, np.inf, np.float32)
        else:
            cluster = cluster.copy()
            upper = outward(upper + self.moved[cluster], True)
            lower = np.maximum(outward(lower - self.moved, False), np.float32(0))
            unsure = upper >= self.nearest[cluster]
            unsure &= ((upper[:, None] >= lower) & (upper[:, None] >= self.half[cluster])).any(axis=1)
        at = np.flatnonzero(unsure)
        best = np.zeros(n, np.int64)
        best[at] = squared(x[at], self.centres[cluster[at]])
        done += len(at)
        root = np.sqrt(best[at])
        upper[at] = outward(root, True)
        lower[at, cluster[at]] = np.maximum(outward(root, False), np.float32(0))
        for j in range(self.k):
            own, reach = cluster[at], upper[at]
            rows = at[(own != j) & (reach >= lower[at, j]) & (reach >= self.half[own, j])]
            if not len(rows):
                continue
            d = squared(x[rows], self.centres[j])
            done += len(rows)
            root = np.sqrt(d)
            lower[rows, j] = np.maximum(outward(root, False), np.float32(0))
            better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            won = rows[better]
            cluster[won], best[won], upper[won] = j, d[better], outward(root[better], True)
        return cluster, upper, lower, done


STATE = [T.StructField("_cluster", T.IntegerType()), T.StructField("_upper", T.FloatType()), T.StructField("_lower", T.ArrayType(T.FloatType()))]


def _assigned(rows: DataFrame, step: Pass, dims: int) -> DataFrame:
    """`rows` with the state after a pass."""
    fields = [f for f in rows.schema.fields if f.name not in {"_cluster", "_upper", "_lower"}]
    held = len(fields) < len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, state = matrix(batch["_x"], dims), (None, None, None)
            if held:
                lower = batch["_lower"].flatten().to_numpy(zero_copy_only=False).reshape(-1, step.k)
                state = batch["_cluster"].to_numpy().astype(np.int64), batch["_upper"].to_numpy(), lower
            cluster, upper, lower, _ = step.assign(x, *state)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, step.k, dtype=np.int32)), pa.array(lower.ravel()))
            columns = [batch[f.name] for f in fields] + [pa.array(cluster.astype(np.int32)), pa.array(upper), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + [f.name for f in STATE])

    return rows.mapInArrow(run, T.StructType([*fields, *STATE]))


def _with_distances(rows: DataFrame, centres: np.ndarray, dims: int) -> DataFrame:
    """id, cluster and the exact squared distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch["_cluster"].to_numpy()
            d = squared(matrix(batch["_x"], dims), centres[cluster])
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_cluster"], pa.array(d)], names=["_id", "_cluster", "distance"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_id"], STATE[0], T.StructField("distance", T.LongType())]))


def _moved(rows: DataFrame, centres: np.ndarray, dims: int) -> np.ndarray:
    """Componentwise floors of the means of each centroid's vectors, from one row of exact sums for each."""
    sums = rows.groupBy("_cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(dims)])
    out = centres.copy()
    for r in sums.collect():  # k rows at most
        out[r["_cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid (array of long) of each kept vector.

    Centroids 0, 1, ... start as the k kept vectors with the smallest sha256 of `<seed>:<id>`. `distance` is
    squared, in units of 1/scale; the inertias sum it over the cluster and over all.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).alias("_id"), quantised(F.col(vector_col), scale).alias("_x"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("_h"), "_x").orderBy("_h", "_x").limit(k).collect()  # k vectors
    schema = T.StructType(
        [vectors.schema[id_col], T.StructField("cluster", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")]
        + [T.StructField("centroid", T.ArrayType(T.LongType()))]
    )
    if not first:
        return spark.createDataFrame([], schema)
    centres = np.array([r["_x"] for r in first], np.int64).reshape(-1, dims)
    step, path = Pass(centres), None
    for done in range(rounds + 1):
        new, new_path = write_table(_assigned(rows, step, dims), "elkan")
        if path:
            remove_table(spark, path)
        rows, path = new, new_path
        if done < rounds:
            before, centres = centres, _moved(rows, centres, dims)
            step = Pass(centres, before)
    placed = cut(_with_distances(rows, centres, dims))
    remove_table(spark, path)
    inertias = {r[0]: r[1] for r in placed.groupBy("_cluster").agg(F.sum("distance")).collect()}  # k rows at most
    total = sum(inertias.values())
    facts = [(j, inertias[j], total, [int(v) for v in centres[j]]) for j in sorted(inertias)]
    small = spark.createDataFrame(facts, "_cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = placed.join(F.broadcast(small), "_cluster")  # k rows
    return out.select(F.col("_id").alias(id_col), F.col("_cluster").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda c: c.cast("string")), ","), 256)
