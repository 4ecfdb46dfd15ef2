"""Snapshots of a geocoder's answers and of census tables, as recorded responses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOCODE = "struct<lat:double,lon:double,state_fips:string,county_fips:string,tract_geoid:string>"


def _place(lat: Column, lon: Column, state: Column, county: Column, tract: Column) -> Column:
    """The struct of a geocode; tract is the whole GEOID of 11 digits, county the first five of it."""
    whole = tract.rlike(r"^\d{11}$")
    return F.when(whole, F.struct(lat.alias("lat"), lon.alias("lon"), state.alias("state_fips"), F.concat(state, county).alias("county_fips"), tract.alias("tract_geoid")))


def batch_geocodes(lines: DataFrame, line: str = "value") -> DataFrame:
    """id and place of a batch answer: id, address, Match or other, kind, matched address, "lon,lat", line id, side, state, county, tract, block.

    Cells can be quoted. A line without a match has a null place; of several lines of an id the least place counts.
    """
    names = ["id", "asked", "status", "kind", "found", "at", "tiger", "side", "state", "county", "tract", "block"]
    cells = F.from_csv(F.col(line), ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true"})
    c = lines.where(F.trim(line) != "").select(cells.alias("c")).select("c.*")
    at = F.split("at", ",")
    lon, lat = (F.get(at, F.lit(i)).try_cast("double") for i in (0, 1))
    place = F.when(F.col("status") == "Match", _place(lat, lon, F.col("state"), F.col("county"), F.concat("state", "county", "tract")))
    return c.select("id", place.alias("place")).groupBy("id").agg(F.min("place").alias("place"))


def oneline_geocodes(responses: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """id and place of one-line answers (JSON): the first address match that has a tract."""
    matches = F.from_json(
        F.get_json_object(F.col(body), "$.result.addressMatches"),
        "array<struct<coordinates:struct<x:double,y:double>,geographies:map<string,array<struct<GEOID:string,STATE:string,COUNTY:string>>>>>",
    )
    tract = lambda m: F.get(F.try_element_at(m["geographies"], F.lit("Census Tracts")), F.lit(0))
    places = F.transform(F.coalesce(matches, F.array()), lambda m: _place(m["coordinates"]["y"], m["coordinates"]["x"], tract(m)["STATE"], tract(m)["COUNTY"], tract(m)["GEOID"]))
    return responses.select(F.col(key).alias("id"), F.get(F.array_compact(places), F.lit(0)).alias("place"))


def geocoded(addresses: DataFrame, tiers: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """`addresses` plus the place of the first tier that has one, `via` (the tier's name) and status (ok or no_geocode).

    A tier is a table of id (as text, unique) and place. Each tier is one join on the id.
    """
    out, places, via = addresses, [], []
    for i, (name, tier) in enumerate(tiers):
        out = out.join(tier.select(F.col("id").cast("string").alias(f"_id{i}"), F.col("place").alias(f"_place{i}")), F.col(key).cast("string") == F.col(f"_id{i}"), "left")
        places.append(F.col(f"_place{i}"))
        via.append(F.when(F.col(f"_place{i}").isNotNull(), name))
    place = F.coalesce(*places)
    facts = [place[f].alias(f) for f in ("lat", "lon", "state_fips", "county_fips", "tract_geoid")]
    return out.select(*[F.col(f"`{c}`") for c in addresses.columns], *facts, F.coalesce(*via).alias("via"), F.when(place.isNotNull(), "ok").otherwise("no_geocode").alias("status"))


def census_estimates(responses: DataFrame, body: str, geography: Sequence[str]) -> DataFrame:
    """geoid, variable, estimate of census answers: a JSON list of lists whose first names the columns.

    `geography` are the columns that make up the GEOID, in order. Negative marks (no estimate) and what is no number become null.
    """
    table = F.from_json(F.col(body), "array<array<string>>")
    rows = responses.select(table.alias("t")).where(F.size("t") > 1).select(F.col("t")[0].alias("head"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1)))).alias("cells"))
    cell = rows.select(F.map_from_arrays("head", "cells").alias("m"))
    geoid = F.concat(*[F.try_element_at("m", F.lit(g)) for g in geography])
    kept = F.map_filter("m", lambda k, v: ~k.isin("NAME", *geography))
    long = cell.select(geoid.alias("geoid"), F.explode(kept).alias("variable", "_v"))
    value = F.col("_v").try_cast("double")
    return long.select("geoid", "variable", F.when(value >= 0, value).alias("estimate"))


def labelled_sums(estimates: DataFrame, variables: DataFrame, measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """geoid and, for each measure, the sum of the estimates whose table and label fit its (table prefix, label pattern).

    `variables` has name and label. Nulls add nothing; a geoid without any estimate of a measure has 0. A measure whose pattern
    fits no variable is 0 everywhere, so `variables` is checked by the caller.
    """
    fits = F.array_compact(F.array(*[F.when(F.col("name").startswith(f"{table}_") & F.col("label").rlike(f"(?i){pattern}"), F.lit(m)) for m, (table, pattern) in measures.items()]))
    of = variables.select(F.col("name").alias("variable"), F.explode(fits).alias("measure")).distinct()
    sums = estimates.join(of, "variable", "left").groupBy("geoid").agg(*[F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("estimate"))), F.lit(0.0)).alias(m) for m in measures])
    return sums
