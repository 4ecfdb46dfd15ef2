import datetime as dt
import random

import pytest

from plinth.plans.q_stream import _run
from plinth.streaming import events as ev
from plinth.streaming import ordered

KIND, START = "event_id long, user_id string, ts timestamp", dt.datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Makes a stream of files, a batch each, and runs the numbering over it."""

    def run(files, late, forget=36_500, close="2200-01-01 00:00:00"):
        for rows in files:
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ordered.closing_row(spark, KIND, close).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = ordered.attempts(ev.read_events(spark, f"{tmp_path}/in", KIND), late=late, forget_days=forget)
        rows, progress = _run(out, str(tmp_path))
        return [r for r in rows.collect() if r.event_id is not None], progress

    return run


def test_rows_out_of_order_get_the_numbers_of_the_ordered_table(stream):
    rng = random.Random(1)
    files = [[(f * 100 + i, f"u{i % 3}" if i % 7 else None, START + dt.timedelta(hours=f * 10 + rng.randint(-8, 8), seconds=i % 5)) for i in range(40)] for f in range(5)]
    files[2].append((999, "u1", None))
    rows, progress = stream(files, "16 hours")
    every, want = [r for f in files for r in f if r[2]], {}
    for user in {r[1] for r in every}:
        want |= {r[0]: n for n, r in enumerate(sorted((r for r in every if r[1] == user), key=lambda r: (r[2], r[0])), 1)}
    assert {r.event_id: r.attempt for r in rows} == want and len(rows) == 200
    assert ordered.late_rows(progress) == 0 and ordered.rows_in_state(progress) <= 5


def test_late_rows_are_counted_apart_and_silent_keys_forgotten(stream):
    day = lambda n: START + dt.timedelta(days=n)
    files = [[(1, "a", day(0)), (2, "b", day(0))], [(3, "a", day(10))], [(4, "a", day(30)), (5, "b", day(1))], [(6, "b", day(31)), (7, "a", day(2))], [(8, "a", day(200))]]
    rows, progress = stream(files, "1 day", forget=60, close="2030-01-01 00:00:00")
    got = {r.event_id: r.attempt for r in rows}
    assert ordered.late_rows(progress) == 2 - (5 in got) and 7 not in got
    assert {k: got[k] for k in (1, 3, 4)} == {1: 1, 3: 2, 4: 3} and got[8] == 1  # silent for more than 60 days
    assert got[6] == 2 + (5 in got)
    assert ordered.rows_in_state(progress) <= 1  # the closing row alone
