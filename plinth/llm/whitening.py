"""Whitening of vectors: Welford's rank-one updates in partitions, merged in parallel, and a symmetric QR eigen-solve.

Components become integers floor(scale * c) + offset. The fit list is each
distinct vector once (a shuffle with partial aggregation, so a vector that is
very common is one row before it moves). Every partition streams its vectors
through Welford's update of count, mean and centred second moments, relative to
`offset`, so that nothing cancels; the states meet by the parallel update
formula, first in groups of MERGED tasks, then MERGED states on the driver. The
covariance (divisor n) is brought to tridiagonal form by Householder
reflections and solved by implicit QR steps with Wilkinson's shift.

Vectors that are null or hold null, NaN or infinite entries are left out, and
so are vectors of another length than most have (ties: the longer). Null and
repeated ids and repeated vectors are rows like any other. Components whose
eigenvalue is not above RANK times the trace are none: fewer components are
returned then, for a single distinct vector (or no vector) none at all.
Components with equal eigenvalues are any orthonormal basis, one for all rows.
Other columns pass through; results that clash with one replace it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import remove_table, write_table
from plinth.llm.elkan import matrix, quantised, usable

#: Partition states are merged in so many tasks before the driver merges the rest.
MERGED = 32
#: Eigenvalues up to this share of the trace are rounding.
RANK = 1e-12

STATE = "part int, n long, sums array<decimal(38,0)>, mean array<double>, m2 array<double>"


@dataclass
class Moments:
    """Count, exact integer sums, mean and centred second moments of vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    m2: np.ndarray

    @staticmethod
    def empty(dims: int) -> Moments:
        return Moments(0, [0] * dims, np.zeros(dims), np.zeros((dims, dims)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, one vector after the other."""
        for row in rows:
            self.n += 1
            gap = row - self.mean
            self.mean += gap / self.n
            self.m2 += np.multiply.outer(gap, gap * ((self.n - 1) / self.n))

    def merged(self, other: Moments) -> Moments:
        """The parallel update formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        m2 = self.m2 + other.m2 + np.multiply.outer(gap, gap) * (self.n * (other.n / n))
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], mean, m2)

    def row(self, part: int) -> dict[str, object]:
        return {"part": part, "n": self.n, "sums": [Decimal(s) for s in self.sums], "mean": self.mean.tolist(), "m2": self.m2.ravel().tolist()}

    @staticmethod
    def of(row: dict[str, object]) -> Moments:
        mean = np.array(row["mean"], float)
        return Moments(int(row["n"]), [int(s) for s in row["sums"]], mean, np.array(row["m2"], float).reshape(len(mean), -1))


_ARROW_STATE = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])


def moments(rows: DataFrame, dims: int, values) -> Moments:
    """Moments over all rows; `values` turns a record batch into (matrix of doubles, its exact integers or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(dims)
        for batch in batches:
            x, exact = values(batch)
            state.add(x)
            if exact is not None and len(exact):
                state.sums = [a + int(b) for a, b in zip(state.sums, exact.sum(axis=0))]
        if state.n:
            yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], schema=_ARROW_STATE)

    def merge(found: pa.Table) -> pa.Table:
        states = [Moments.of(r) for r in sorted(found.drop_columns(["group"]).to_pylist(), key=lambda r: r["part"])]
        total = Moments.empty(dims)
        for s in states:
            total = total.merged(s)
        first = found["part"][0].as_py() % MERGED
        return pa.Table.from_pylist([total.row(first)], schema=_ARROW_STATE)

    parts = rows.mapInArrow(run, STATE).withColumn("group", F.col("part") % MERGED)
    merged = parts.groupBy("group").applyInArrow(merge, STATE)
    total = Moments.empty(dims)
    for r in sorted(merged.collect(), key=lambda r: r["part"]):  # MERGED rows at most
        total = total.merged(Moments.of(r.asDict()))
    return total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q', by Householder reflections."""
    t, n = (a + a.T) / 2, len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = t[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        t[k + 1 :] -= 2 * np.outer(v, v @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(t).copy(), np.diag(t, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by implicit QR steps."""
    d, e, q = tridiagonal(a)
    tiny, last = np.finfo(float).eps, len(d) - 1
    while last > 0:
        e[np.abs(e) <= tiny * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[last - 1] == 0:
            last -= 1
            continue
        first = last - 1
        while first > 0 and e[first - 1] != 0:
            first -= 1
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + math.copysign(math.hypot(half, e[last - 1]), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            a0, a1, b = d[k], d[k + 1], e[k]
            d[k] = c * c * a0 + 2 * c * s * b + s * s * a1
            d[k + 1] = s * s * a0 - 2 * c * s * b + c * c * a1
            e[k] = (c * c - s * s) * b + c * s * (a1 - a0)
            if k < last - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[:, k : k + 2] = q[:, k : k + 2] @ np.array([[c, -s], [s, c]])
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Whitening:
    """A fitted model: sums and count of the fit list, components (rows), their eigenvalues and share of the trace."""

    n: int
    dims: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where that fits, Python integers beyond."""
        most = self.n * (int(np.abs(x).max(initial=0)) + max(1, max(abs(s) for s in self.sums) // self.n + 1))
        wide = x if most < 1 << 62 else x.astype(object)
        return wide * self.n - np.array(self.sums, dtype=wide.dtype)

    def deviation(self, gaps: np.ndarray) -> list[int]:
        """Exact sums of squares."""
        most = int(np.abs(gaps).max(initial=0)) ** 2 * self.dims
        return (gaps if most < 1 << 63 else gaps.astype(object)).__pow__(2).sum(axis=1).tolist()

    def whitened(self, gaps: np.ndarray) -> np.ndarray:
        """x - S/n on the components, over the roots of their eigenvalues."""
        return (gaps.astype(float) / self.n) @ (self.components / np.sqrt(self.values)[:, None]).T


def fit(vectors: DataFrame, most: int = 16, scale: int = 64, offset: int = 1_000_000, vector_col: str = "embedding") -> Whitening | None:
    """Model of up to `most` components over each distinct vector; None without usable vectors."""
    good = vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0))
    sizes = good.groupBy(F.size(vector_col).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return None
    dims = int(sizes["dims"])
    x = good.where(F.size(vector_col) == dims).select(quantised(F.col(vector_col), scale, offset).alias("x"))
    listed, path = write_table(x.distinct(), "whitening")

    def shifted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        exact = matrix(batch["x"], dims)
        return (exact - offset).astype(float), exact

    found = moments(listed, dims, shifted)
    values, axes = symmetric_qr(found.m2 / found.n)
    trace = float(np.trace(found.m2) / found.n)
    use = [i for i in range(min(most, dims)) if values[i] > RANK * trace]
    model = Whitening(found.n, dims, found.sums, axes[:, use].T.copy(), values[use], values[use] / trace if trace else values[use])
    if use:
        again = moments(listed, len(use), lambda batch: (model.whitened(model.centred(matrix(batch["x"], dims))), None))
        model.identity_error = float(np.abs(again.m2 / again.n - np.eye(len(use))).max())
    remove_table(vectors.sparkSession, path)
    return model


def transform(vectors: DataFrame, model: Whitening, scale: int = 64, offset: int = 1_000_000, vector_col: str = "embedding") -> DataFrame:
    """Rows with usable vectors of the model's length, plus deviation (sum of (n*x-S)^2, exact) and whitened (array of double)."""
    rows = vectors.where(usable(F.col(vector_col), model.dims))
    kept = [f for f in rows.schema.fields if f.name.lower() not in {"deviation", "whitened"}]
    rows = rows.select(*[f.name for f in kept], quantised(F.col(vector_col), scale, offset).alias("_x_of_vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.values)
        for batch in batches:
            gaps = model.centred(matrix(batch["_x_of_vector"], model.dims))
            out = np.ascontiguousarray(model.whitened(gaps))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(gaps) + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            exact = pa.array([Decimal(v) for v in model.deviation(gaps)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], exact, lists], names=[*[f.name for f in kept], "deviation", "whitened"])

    added = [T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType([*kept, *added]))


def by_component(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Fit and transform, one row for each usable vector and component (from 1).

    Columns: the id, component, n, deviation (null where it exceeds a long), whitened, explained, identity_error.
    """
    spark = vectors.sparkSession
    names = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    light = vectors.select(F.col(id_col), F.col(vector_col))
    model = fit(light, most, scale, offset, vector_col)
    if model is None or not len(model.values):
        return spark.createDataFrame([], T.StructType([vectors.schema[id_col], *T._parse_datatype_string(names).fields]))
    rows = transform(light, model, scale, offset, vector_col).select(id_col, "deviation", F.posexplode("whitened").alias("_at", "_w"))
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    return rows.select(
        id_col, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"),
        F.col("_w").alias("whitened"), shares[F.col("_at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
