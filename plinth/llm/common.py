"""Shared helpers: table access, checkpoints, Arrow text buffers and bounded-task ranking."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows in one Arrow batch. Texts can be long, so batches stay small in rows.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; where none is named, one of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plinth-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A Parquet table written in the shared folder, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, name)[0]


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table that this process wrote and that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def if_small(ids: DataFrame, most: int) -> DataFrame:
    """A checkpointed table of longs, to be broadcast if it has at most `most` rows (about 32 bytes each in memory)."""
    held = cut(ids)
    return F.broadcast(held) if held.count() <= most else held


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (or the bytes of a binary column) of all rows and the int64 offsets of the rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    large = column.cast(pa.large_binary() if binary else pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    raw = large.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) row ranges of about `most` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str, spread: int = 64, bucket: Column | None = None) -> DataFrame:
    """Gapless 0-based number of each row within `keys`, without one task holding a whole key.

    Rows of a key are dealt into `spread` buckets by a hash of `order`; the
    number is the rows of earlier buckets plus the rank within the bucket. With
    a `bucket` that never falls as `order` rises, numbers follow `order`.
    Ties in `order` are numbered in any order. Null keys form a key.
    """
    own = f"_{name}_bucket"
    dealt = df.withColumn(own, F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int") if bucket is None else bucket)
    before = Window.partitionBy(*keys).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, own).agg(F.count("*").alias("_n"))
    counts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, own]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, own]]
    joined = dealt.join(counts, same).drop(*[f"_of_{k}" for k in [*keys, own]])
    rank = F.row_number().over(Window.partitionBy(*keys, own).orderBy(*order))
    return joined.withColumn(name, (F.col("_base") + rank - 1).cast("long")).drop("_base", own)


def ids_tell_rows(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null or repeated."""
    return df.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_id is null or _n > 1").isEmpty()


def with_row_keys(df: DataFrame, name: str) -> DataFrame:
    """`df`, checkpointed, plus a unique long for each row that rises with the order of rows."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def told_apart(df: DataFrame, id_col: str, name: str) -> tuple[DataFrame, bool]:
    """`df` plus a key that tells rows apart, and whether that is the id itself: null and repeated ids give way to row numbers."""
    if ids_tell_rows(df, id_col):
        return df.withColumn(name, F.col(id_col)), True
    return with_row_keys(df, name), False


def aside(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with all columns but the needed ones under private names, so that no name of an operator's own meets them, and the way back."""
    hidden = {c: c if c in needed else f"_carried_{i}" for i, c in enumerate(df.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(h).alias(c) for c, h in hidden.items()])

    return df.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]), back


def with_fields(df: DataFrame, **added: T.DataType) -> T.StructType:
    """Schema of `df` plus fields."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in added.items()]])
