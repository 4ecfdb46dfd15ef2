"""Structured Streaming on the events table: ingest, windows and an upsert sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups into which the keys of a stream with state are hashed; a stream that goes on from a checkpoint needs the same number.
BUCKETS = 1024

#: The bucket of null keys.
NO_KEY = -1


def read_events(spark: SparkSession, path: str, schema: str, files_each: int = 1, ts: str = "ts") -> DataFrame:
    """A stream of parquet files under a declared schema; a time without zone is read in the session's, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, size: str, by: list[str], ts: str = "ts", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by time window, on a stream or a table; `late` sets the watermark of a stream that has none yet."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions of a key that end after a gap; `late` as in `tumbling`."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def bucketed(events: DataFrame, key: str) -> DataFrame:
    """`events` plus `_bucket`, the group of keys that shares one call of Python and one row of state; null keys have a bucket of their own.

    There a whole number stands in for the null, as pandas would make floats of all keys beside it.
    """
    bucket = F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    kind = events.schema[key].dataType.simpleString()
    known = F.coalesce(F.col(key), F.lit(0).cast(kind)) if kind in ("tinyint", "smallint", "int", "bigint") else F.col(key)
    return events.withColumn("_bucket", bucket).withColumn(key, known)


def key_codes(bucket: int, keys: pd.Series) -> tuple[np.ndarray, list]:
    """Each row's number among the different keys of a bucket, and these keys."""
    if bucket == NO_KEY:
        return np.zeros(len(keys), "int64"), keys.head(1).tolist()
    codes, found = pd.factorize(keys)
    return codes, found.tolist()


def second_attempts(events: DataFrame, key: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """key, attempt, ts: each row numbered within its key by time, on a stream, by state that outlives batches.

    Rows of a batch are put in order of time; a row that comes in a later batch is a later attempt. State is one
    counter for each key, held by buckets of keys: a call for each key would cost more than its rows.
    """

    def number(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)], ignore_index=True).sort_values(ts, kind="stable", ignore_index=True)
        who, seen = state.get if state.exists else ([], [])
        held = pd.Series(who, dtype=rows[key].dtype)
        codes, keys = key_codes(bucket[0], pd.concat([held, rows[key]], ignore_index=True))
        counts = np.zeros(len(keys), "int64")
        counts[codes[: len(held)]] = seen
        mine = pd.Series(codes[len(held) :])
        attempt = counts[mine] + mine.groupby(mine).cumcount().to_numpy() + 1
        counts += np.bincount(mine, minlength=len(keys))
        state.update((keys, counts.tolist()))
        yield pd.DataFrame({"_known": bucket[0] != NO_KEY, key: rows[key], "attempt": attempt, ts: rows[ts]})

    kind = events.schema[key].dataType.simpleString()
    marked = bucketed(events.withWatermark(ts, late).select(key, ts), key)
    out = marked.groupBy("_bucket").applyInPandasWithState(number, f"_known boolean, `{key}` {kind}, attempt long, `{ts}` timestamp", f"who array<{kind}>, seen array<long>", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.when(F.col("_known"), F.col(key)).alias(key), "attempt", ts)


def collected(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for the files that are there now, written under `folder` and read back.

    In append mode rows are the sink's. In update mode the last row of each of `keys` counts: batches are numbered,
    and a replayed batch replaces itself.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{folder}/out")
    if mode == "append":
        return rows.drop("batch")
    rest = F.struct(*stream.columns)
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(rest, "batch").alias("_row")).select("_row.*")


def upsert_sink(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch to a keyed upsert; replays of a batch id must be harmless."""
    return stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
