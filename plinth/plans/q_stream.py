"""Queries of streams whose files come out of order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.lineage import scratch_path
from plinth.plans.registry import query
from plinth.sources.io import read_table as t
from plinth.streaming import events as ev
from plinth.streaming import ordered

Spark = SparkSession

#: Files of the stream, and by how many hours a row can stand apart from its time.
FILES, APART = 6, 6
_SPAN = "s AS (SELECT epoch(min(ts)) AS t0, epoch(max(ts)) AS t1 FROM events)"
_LATE = "event_id % 97 = 0 AND epoch(ts) < t0 + 0.4 * (t1 - t0)"


def _jumbled_stream(spark: Spark, d: str, tag: str) -> tuple[DataFrame, str]:
    """Events in files cut by time give or take APART hours; some old rows come in the last file. A closing row follows."""
    events = t(spark, d, "events")
    folder, kinds = scratch_path(spark, tag), ", ".join(f"{n} {k}" for n, k in events.dtypes)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    t0, t1 = events.agg(F.min(seconds), F.max(seconds)).first()
    apart = F.pmod(F.xxhash64("event_id"), F.lit(2 * APART * 3600)) - APART * 3600
    place = F.least(F.greatest(F.floor((seconds + apart - t0) * FILES / F.lit(max(t1 - t0, 1))), F.lit(0)), F.lit(FILES - 1))
    late = (F.col("event_id") % 97 == 0) & (seconds < F.lit(t0) + 0.4 * F.lit(t1 - t0))
    filed = events.withColumn("_file", F.when(late, FILES - 1).otherwise(place))
    for k in range(FILES):  # one write after the other: a stream takes files in the order in which they came
        filed.where(F.col("_file") == k).drop("_file").repartition(1).write.mode("append").parquet(folder)
    ordered.closing_row(spark, kinds, "2200-01-01 00:00:00").coalesce(1).write.mode("append").parquet(folder)
    return ev.read_events(spark, folder, kinds), scratch_path(spark, f"{tag}-out")


def _run(stream: DataFrame, folder: str) -> tuple[DataFrame, list[dict]]:
    """Appended rows of a stream over the files that are there now, and its progress."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    started = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    rows = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{folder}/out")
    return rows.drop("batch"), [json.loads(p.json) for p in started.recentProgress]


@query(f"WITH {_SPAN} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, ts, event_id, (SELECT count(*) FROM events, s WHERE {_LATE}) AS n_late FROM events, s WHERE NOT ({_LATE})")
def stream_attempts_in_order(spark: Spark, d: str) -> DataFrame:
    stream, folder = _jumbled_stream(spark, d, "jumbled")
    rows, progress = _run(ordered.attempts(stream, late="13 hours"), folder)
    rows = rows.where("event_id is not null")
    return rows.select("user_id", "attempt", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.lit(ordered.late_rows(progress)).cast("long").alias("n_late"))


@query(f"""WITH {_SPAN}, k AS (SELECT user_id, ts FROM events, s WHERE NOT ({_LATE})), g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM k),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM n GROUP BY user_id, n.n""")
def stream_sessions_of_a_stream(spark: Spark, d: str) -> DataFrame:
    stream, folder = _jumbled_stream(spark, d, "sessions")
    rows, _ = _run(ev.sessions(stream, "2 hours", late="13 hours"), folder)
    return rows.where("user_id is not null").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query(f"WITH {_SPAN} SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w, event_type, value FROM events, s WHERE NOT ({_LATE})) GROUP BY ALL")
def stream_sliding_windows(spark: Spark, d: str) -> DataFrame:
    stream, folder = _jumbled_stream(spark, d, "sliding")
    rows, _ = _run(ev.tumbling(stream, "24 hours", ["event_type"], late="13 hours", slide="12 hours"), folder)
    return rows.where("event_type is not null").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
