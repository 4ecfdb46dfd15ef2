import json
import sys

import pytest

import __spark_entry__ as entry
from plinth.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    left = sorted(tuple(cell(v) for v in r) for r in got.select(*names).collect())
    right = sorted(tuple(cell(v) for v in r) for r in want.select(*[f'"{c}"' for c in names]).fetchall())
    assert left == right


def test_mixed_models_give_finite_effects(spark):
    """The queries without SQL: random intercepts, which test_mixed.py holds against direct integration and test_crossed.py against dense algebra."""
    names = sorted(set(registry.queries()) - set(registry.oracle_sql()))
    effects = ["st_04_binomial_mixed", "st_04_crossed", "st_05_crossed", "st_05_negative_binomial_mixed"]
    assert names == [*effects, "st_14_crossed_components"]
    parts = registry.queries()["st_14_crossed_components"](spark, DATA).collect()
    assert len(parts) == 3 and abs(sum(r.icc for r in parts) - 1) < 1e-9 and all(r.variance >= 0 for r in parts)
    for name in effects:
        rows = registry.queries()[name](spark, DATA).collect()
        assert len(rows) == 2 and all(0 < r.low <= r.estimate <= r.high < 1e4 and 0 <= r.p_value <= 1 for r in rows)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert json.dumps(sorted(entry.queries())) and "plinth" in sys.modules


def test_streaming_equals_batch(spark, tmp_path):
    from plinth.streaming import events as ev

    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    stream = ev.tumbling(ev.deduplicated(ev.read_events(spark, f"{tmp_path}/in", schema), late="60 days"), "1 day", ["event_type"])
    rows = {}

    def merge(df, batch_id):
        for r in df.collect():
            rows[r.window_start, r.event_type] = (r.n, round(r.total, 2))

    q = ev.upsert_sink(stream, merge, f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.window_start, r.event_type): (r.n, round(r.total, 2)) for r in ev.tumbling(table.withColumn("ts", table["ts"].cast("timestamp")), "1 day", ["event_type"]).collect()}
    assert rows == want
