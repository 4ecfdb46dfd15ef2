import json

from plinth.sources import geodata


def test_batch_lines(spark):
    lines = ['"1","9 A St, Town, FL, 33130","Match","Exact","9 A ST, TOWN, FL","-80.1,25.7","7","L","12","086","006701","1000"', '"2","x","No_Match"', '"3","x","Tie"', "", '"4","x","Match","Exact","y","bad","7","L","12","086","67","1"', '1,"x",No_Match']
    got = {r.id: r.place for r in geodata.batch_geocodes(spark.createDataFrame([(v,) for v in lines], "value string")).collect()}
    assert tuple(got["1"]) == (25.7, -80.1, "12", "12086", "12086006701") and got["2"] is got["3"] is got["4"] is None and len(got) == 4


def test_oneline_answers_and_tiers(spark):
    tract = {"GEOID": "12086006701", "STATE": "12", "COUNTY": "086"}
    hit = lambda g: {"coordinates": {"x": -80.0, "y": 25.0}, "geographies": g}
    bodies = {"a": [hit({"Census Tracts": [tract]})], "b": [hit({}), hit({"Census Tracts": []}), hit({"Census Tracts": [tract]})], "c": [], "d": [hit({"Census Tracts": [{**tract, "GEOID": "short"}]})]}
    rows = [(k, json.dumps({"result": {"addressMatches": v}})) for k, v in bodies.items()] + [("e", "<html>"), ("f", None)]
    one = geodata.oneline_geocodes(spark.createDataFrame(rows, "id string, body string"))
    assert {r.id: r.place and r.place.tract_geoid for r in one.collect()} == {"a": "12086006701", "b": "12086006701", "c": None, "d": None, "e": None, "f": None}
    batch = geodata.batch_geocodes(spark.createDataFrame([('"a","x","Match","Exact","y","1,2","7","L","01","002","000300","1"',), ('"z","x","Match","Exact","y","1,2","7","L","01","002","000300","1"',)], "value string"))
    asked = spark.createDataFrame([("a", "own"), ("b", "own"), ("c", None), (None, "own")], "id string, via string").withColumnRenamed("via", "note")
    got = {r.id: (r.via, r.status, r.county_fips) for r in geodata.geocoded(asked, [("batch", batch), ("one", one)], "id").collect()}
    assert got == {"a": ("batch", "ok", "01002"), "b": ("one", "ok", "12086"), "c": (None, "no_geocode", None), None: (None, "no_geocode", None)}


def test_census_tables(spark):
    bodies = [json.dumps([["NAME", "B1_001", "B1_002", "state", "county", "tract"], ["T", "5", "-666666666", "12", "086", "006701"], ["T", None, "x", "12", "086", "006702"]]), json.dumps([["NAME"]]), "no", None, json.dumps([["B2_001", "state", "county", "tract"], ["8", "12", "086", "006701"]])]
    e = geodata.census_estimates(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", ["state", "county", "tract"])
    assert {(r.geoid, r.variable, r.estimate) for r in e.collect()} == {("12086006701", "B1_001", 5.0), ("12086006701", "B1_002", None), ("12086006702", "B1_001", None), ("12086006702", "B1_002", None), ("12086006701", "B2_001", 8.0)}
    v = spark.createDataFrame([("B1_001", "Total: Female"), ("B1_002", "total: female: covered"), ("B2_001", "Total: Female")], "name string, label string")
    sums = geodata.labelled_sums(e, v, {"all": ("B1", "^total: female$"), "both": ("B1", "female"), "other": ("B2", "Female"), "none": ("B3", "x")})
    assert {(r.geoid, r["all"], r.both, r.other, r.none) for r in sums.collect()} == {("12086006701", 5.0, 5.0, 8.0, 0.0), ("12086006702", 0.0, 0.0, 0.0, 0.0)}
