"""Ordered release of a stream's rows: state with event-time timers that ends.

Rows of a key are buffered until the watermark has passed them, then released
in order of time with a number that goes on from batch to batch, so files that
come out of order give the numbers of the ordered table, for all rows within
the watermark. Rows behind it never reach the state; the sink's progress counts
them. A key that has been silent for `forget` (event time) loses its state: its
next row starts anew. Null keys are one key; rows without a time are left out.
State lives in RocksDB; a key holds the rows of one watermark delay and a counter.
Keys share state by buckets (`events.bucketed`), as a call for each key would cost
more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from plinth.streaming.events import NO_KEY, bucketed, key_codes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Stands for a null tie, before all others.
NO_TIE = -(1 << 63)


class Ordered(StatefulProcessor):
    """Buffers rows (key, time in microseconds, order key) of a bucket and numbers what the watermark has passed."""

    def __init__(self, key: str, kind: str, tie: str, forget_ms: int):
        self.key, self.kind, self.tie, self.forget_ms = key, kind, tie, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"who array<{self.kind}>, at array<long>, tie array<long>")
        self.counter = handle.getValueState("counter", f"who array<{self.kind}>, n array<long>, last array<long>")

    def _held(self, state, names: tuple[str, str, str]) -> pd.DataFrame | None:
        return pd.DataFrame(dict(zip(names, state.get()))) if state.exists() else None

    def _hold(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.update(tuple(rows[c].tolist() for c in rows))
        elif state.exists():
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = [pd.DataFrame({"who": r[self.key], "at": r["at_us"].astype("int64"), "tie": r[self.tie].astype("int64")}) for r in rows if len(r)]
        self.handle.registerTimer(int(min(f["at"].min() for f in found)) // 1000)
        before = self._held(self.waiting, ("who", "at", "tie"))
        self._hold(self.waiting, pd.concat(found if before is None else [before, *found], ignore_index=True))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows, counts = self._held(self.waiting, ("who", "at", "tie")), self._held(self.counter, ("who", "n", "last"))
        is_ready = rows["at"] // 1000 <= passed if rows is not None else pd.Series([], dtype=bool)
        ready = rows[is_ready] if is_ready.any() else None
        parts = [f["who"] for f in (counts, ready) if f is not None]
        if not parts:
            return
        codes, who = key_codes(key[0], pd.concat(parts, ignore_index=True))
        n, last, known = np.zeros(len(who), "int64"), np.zeros(len(who), "int64"), 0 if counts is None else len(counts)
        if known:
            n[codes[:known]], last[codes[:known]] = counts["n"], counts["last"]
        if ready is not None:
            rest = rows[~is_ready]
            self._hold(self.waiting, rest)
            if len(rest):
                self.handle.registerTimer(int(rest["at"].min()) // 1000)
            ready = ready.assign(code=codes[known:]).sort_values(["code", "at", "tie"], kind="stable")
            code, ms, place = ready["code"].to_numpy(), ready["at"].to_numpy() // 1000, np.arange(len(ready))
            first = np.r_[True, code[1:] != code[:-1]]
            anew = np.where(first, n[code] == 0, False) | (ms - np.where(first, last[code], np.r_[0, ms[:-1]]) > self.forget_ms)
            start = np.maximum.accumulate(np.where(first | anew, place, 0))
            attempt = place - start + 1 + np.where(anew, 0, n[code])[start]
            ends = np.r_[first[1:], True]
            n[code[ends]], last[code[ends]] = attempt[ends], ms[ends]
            yield pd.DataFrame({"_known": key[0] != NO_KEY, self.key: ready["who"], "attempt": attempt, "at_us": ready["at"], self.tie: ready["tie"]})
        # A key goes when a row that can still come would be counted anew.
        kept = last + self.forget_ms >= passed
        self._hold(self.counter, pd.DataFrame({"who": pd.Series(who)[kept], "n": n[kept], "last": last[kept]}))
        if kept.any():
            self.handle.registerTimer(int(last[kept].min()) + self.forget_ms + 1)


def attempts(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", late: str = "1 hour", forget_days: int = 36_500) -> DataFrame:
    """key, attempt, ts, tie: each row's number within its key by time (ties by the long column `tie`), on a stream."""
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = dict(events.dtypes)[key]
    marked = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, ts, F.coalesce(F.col(tie).cast("long"), F.lit(NO_TIE)).alias(tie), F.unix_micros(ts).alias("at_us"))
    schema = f"_known boolean, `{key}` {kind}, attempt long, at_us long, `{tie}` long"
    out = bucketed(marked, key).groupBy("_bucket").transformWithStateInPandas(Ordered(key, kind, tie, forget_days * 86_400_000), schema, "Append", "eventTime")
    return out.select(F.when(F.col("_known"), F.col(key)).alias(key), "attempt", F.timestamp_micros("at_us").alias(ts), F.when(F.col(tie) != NO_TIE, F.col(tie)).alias(tie))


def closing_row(spark: SparkSession, schema: str, at: str, ts: str = "ts") -> DataFrame:
    """A row with a time alone: written as a stream's last file, it moves the watermark past all others."""
    empty = spark.createDataFrame([], schema)
    columns = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
    return spark.range(1).select(*columns)


def late_rows(progress: list[dict]) -> int:
    """Rows that came behind the watermark, from a query's progress."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))


def rows_in_state(progress: list[dict]) -> int:
    """Rows of state after the last batch."""
    return int(progress[-1]["stateOperators"][0]["numRowsTotal"]) if progress and progress[-1].get("stateOperators") else 0
