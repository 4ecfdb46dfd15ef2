import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from plinth.sources import intake, registry
from plinth.sources.io import ContractError


def hit(number, last, city="X", primary=True):
    return {"number": number, "basic": {"first_name": "A", "last_name": last, "sex": "F"}, "addresses": [{"address_purpose": "MAILING", "city": "no"}, {"address_purpose": "LOCATION", "city": city}], "taxonomies": [{"code": "t0"}, {"code": "t1", "primary": primary}]}


@pytest.fixture
def snapshot(tmp_path):
    for state, lines in {"FL": [{"results": [hit("1", "Lee"), hit("2", "Roe")]}, {"result_count": 0, "results": []}], "GA": [{"results": [hit("3", "Lee", primary=False)]}], "TX": [{"results": [{"number": "4", "basic": None}]}]}.items():
        os.makedirs(f"{tmp_path}/state={state}")
        with open(f"{tmp_path}/state={state}/a.txt", "w") as f:
            f.write("\n".join(map(json.dumps, lines)) + "\n\n")
    return str(tmp_path)


def test_filters_on_the_state_leave_out_files(spark, snapshot):
    all_rows = registry.read_snapshot(spark, snapshot)
    assert all_rows.rdd.getNumPartitions() == 3
    assert {(r.state, r.number, r.last_name, r.city, r.taxonomy) for r in all_rows.collect()} == {("FL", "1", "Lee", "X", "t1"), ("FL", "2", "Roe", "X", "t1"), ("GA", "3", "Lee", "X", "t0"), ("TX", "4", None, None, None)}
    one = all_rows.where("state = 'FL' and last_name = 'Lee'")
    assert one.rdd.getNumPartitions() == 1 and [r.number for r in one.collect()] == ["1"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter")[1].split("\n")[0]
    assert "= FL" not in left and "= Lee" in left
    assert all_rows.where(F.col("state").isin("GA", "TX")).rdd.getNumPartitions() == 2
    assert all_rows.where("state = 'ZZ'").collect() == []


def test_responses_that_are_errors(spark, snapshot):
    with open(f"{snapshot}/state=GA/b.txt", "w") as f:
        f.write('{"Errors": [{"description": "busy"}]}\n<html>\n[1]\n' + json.dumps({"results": [hit("9", "Poe")]}))
    with pytest.raises(Exception, match="not a registry response"):
        registry.read_snapshot(spark, snapshot).collect()
    assert {r.number for r in registry.read_snapshot(spark, snapshot, "skip").collect()} == {"1", "2", "3", "4", "9"}


def test_lookup_falls_back_to_the_nation(spark, snapshot):
    p = spark.createDataFrame([(1, "Lee", "GA"), (2, "Lee", "TX"), (3, "Roe", None), (4, "Nobody", "FL"), (5, None, "FL")], "id long, last_name string, state string")
    got = {r.id: (r.scope, r.n_hits, r.number) for r in registry.looked_up(p, registry.read_snapshot(spark, snapshot), ["last_name"]).collect()}
    assert got == {1: ("state", 1, "3"), 2: ("nationwide", 2, "1"), 3: ("nationwide", 1, "2"), 4: ("none", 0, None), 5: ("none", 0, None)}


def test_manifest_is_resumed(spark, tmp_path):
    def put(name, text, at):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))

    for name, text in (("a.csv", "one\n" * 10), ("b.csv", "two\n" * 10), ("c.csv", "<html>"), ("d.csv", "")):
        put(name, text, 1_600_000_000)
    first = intake.manifest(spark, str(tmp_path), least_bytes=10, glob="*.csv").checkpoint()
    of = lambda m: {os.path.basename(r.path): (r.status, r.sha256) for r in m.collect()}
    assert of(first) == {"a.csv": ("read", hashlib.sha256(b"one\n" * 10).hexdigest()), "b.csv": ("read", hashlib.sha256(b"two\n" * 10).hexdigest()), "c.csv": ("short", None), "d.csv": ("short", None)}
    with pytest.raises(ContractError, match="c.csv"):
        intake.manifest_gate(first)
    put("b.csv", "TWO\n" * 10, 1_600_000_100)  # as long as before
    put("c.csv", "three\n" * 10, 1_600_000_100)
    (tmp_path / "d.csv").unlink()
    put("e.csv", "x" * (9 << 20), 1_600_000_000)
    marked = first.withColumn("sha256", F.when(F.col("path").endswith("a.csv"), "as known").otherwise(F.col("sha256")))
    second = intake.manifest(spark, str(tmp_path), marked, least_bytes=10, glob="*.csv")
    assert of(second) == {"a.csv": ("kept", "as known"), "b.csv": ("read", hashlib.sha256(b"TWO\n" * 10).hexdigest()), "c.csv": ("read", hashlib.sha256(b"three\n" * 10).hexdigest()), "e.csv": ("read", hashlib.sha256(b"x" * (9 << 20)).hexdigest())}
    intake.manifest_gate(second)
    plan = intake.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "path#" in plan and "content#" not in plan


PAYLOADS = {
    1: None, 2: " \n", 3: "  <!doctype html>", 4: '{"a": 1', 5: '{"error": "no token"}', 6: "12", 7: '"text"', 8: "[1, 2]", 9: "null", 10: '{"a": 1, "b": "x"}', 11: '[{"a": 2, "b": "y"}, {"a": 3, "b": "z"}]',
    12: "[]", 13: '[{"a": "no"}, {"b": "x"}]', 14: '{"a": null, "b": "x"}', 15: '{"a": 1, "b": "x", "error": null}',
}


def test_payload_findings(spark):
    df = spark.createDataFrame(list(PAYLOADS.items()), "id long, body string")
    kinds = {r.id: r.kind for r in df.select("id", intake.payload_kind(F.col("body")).alias("kind")).collect()}
    assert kinds == {1: "missing", 2: "empty", 3: "html", 4: "not_json", 5: "error", **dict.fromkeys((6, 7, 8, 9), "wrong_shape"), **dict.fromkeys((10, 11, 12, 13, 14, 15), "ok")}
    found = {(r.key, r.finding, r.detail) for r in intake.payload_findings(df, "body", {"$.a": "int", "$.b": "string"}, "id").collect() if r.key >= 10}
    assert found == {(13, "wrong_type", "$.a of item 0"), (13, "missing_field", "$.b of item 0"), (13, "missing_field", "$.a of item 1"), (14, "missing_field", "$.a of item 0")}
    assert intake.payload_schema(df.where("id = 10"), "body") == "OBJECT<a: BIGINT, b: STRING>" and intake.payload_schema(df.where("id < 10"), "body") is None
