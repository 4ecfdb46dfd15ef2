import datetime as dt
import random

from plinth.streaming import events as ev
from plinth.streaming import ordered

START, BIG = dt.datetime(2024, 1, 1), 1 << 60


def test_attempts_share_calls_and_state_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ev, "BUCKETS", 2)
    rng = random.Random(4)
    kind, want, seen = "user_id long, ts timestamp", [], {}
    for f in range(3):
        rows = [(rng.choice([None, 0, *range(BIG, BIG + 20)]), START + dt.timedelta(seconds=f * 1000 + i)) for i in range(200)]
        for user, ts in rows:
            seen[user] = seen.get(user, 0) + 1
            want.append((str(user), seen[user], ts))
        rng.shuffle(rows)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ev.second_attempts(ev.read_events(spark, f"{tmp_path}/in", kind))
    started = stream.writeStream.format("memory").queryName("attempts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    started.awaitTermination()
    got = [(str(r.user_id), r.attempt, r.ts) for r in spark.table("attempts").collect()]
    assert sorted(got) == sorted(want)
    assert ordered.rows_in_state([{"stateOperators": p.stateOperators and [{"numRowsTotal": p.stateOperators[0].numRowsTotal}]} for p in started.recentProgress]) <= 3
