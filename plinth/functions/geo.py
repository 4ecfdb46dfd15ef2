"""Distances and radius joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in miles.
EARTH_MILES = 3959.0


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, missing: float | None = None) -> Column:
    """Great-circle miles; a null coordinate gives `missing` (null, or infinity for a matcher)."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    d = 2 * EARTH_MILES * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))
    return d if missing is None else F.coalesce(d, F.lit(missing))


def _cells(lat: Column, lon: Column, miles: float) -> tuple[Column, Column, Column]:
    """Latitude band, longitude cell and the number of cells around the band; a cell is at least `miles` wide."""
    degrees = math.degrees(miles / EARTH_MILES) * 1.0001
    band = F.floor(lat / degrees)
    # The band's edge nearest a pole is where a degree of longitude is shortest; neighbours may lie one band on.
    edge = F.least(F.greatest(F.abs(band + 2), F.abs(band - 1)) * degrees, F.lit(90.0))
    around = F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / degrees), F.lit(1))
    return band, F.floor((lon + 180.0) / 360.0 * around), around


#: Most rows of one place in one list of `within_miles`.
ROWS_OF_A_LIST = 256


def _near(a: DataFrame, b: DataFrame, miles: float, on: list[str], lat: str, lon: str) -> DataFrame:
    """Pairs of rows of `a` (left_ columns) and `b` (right_ columns) at most `miles` apart, and `miles`."""
    band, cell, _ = _cells(F.col(f"left_{lat}"), F.col(f"left_{lon}"), miles)
    a = a.withColumn("_band", band).withColumn("_cell", cell)
    degrees = math.degrees(miles / EARTH_MILES) * 1.0001
    near = b.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(f"right_{lat}") / degrees) + d)))
    edge = F.least(F.greatest(F.abs(F.col("_band") + 2), F.abs(F.col("_band") - 1)) * degrees, F.lit(90.0))
    near = near.withColumn("_around", F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / degrees), F.lit(1)))
    own = F.floor((F.col(f"right_{lon}") + 180.0) / 360.0 * F.col("_around"))
    cells = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(own + d, F.col("_around"))))
    near = near.withColumn("_cell", F.explode(cells)).drop("_around")
    a = a.withColumn("_cell", F.pmod(F.col("_cell"), _cells(F.col(f"left_{lat}"), F.col(f"left_{lon}"), miles)[2]))
    condition = (a["_band"] == near["_band"]) & (a["_cell"] == near["_cell"])
    for k in on:
        condition = condition & (F.col(f"left_{k}") == F.col(f"right_{k}"))
    d = haversine_miles(F.col(f"left_{lat}"), F.col(f"left_{lon}"), F.col(f"right_{lat}"), F.col(f"right_{lon}"))
    joined = a.join(near, condition).drop("_band", "_cell").withColumn("miles", d)
    return joined.where(F.col("miles") <= miles)


def _side(df: DataFrame, side: str, lat: str, lon: str) -> DataFrame:
    """Rows with coordinates, their columns marked with the side."""
    return df.select(*[F.col(f"`{c}`").alias(f"{side}_{c}") for c in df.columns]).where(f"{side}_{lat} is not null and {side}_{lon} is not null")


def _listed(df: DataFrame, place: list[str], name: str) -> DataFrame:
    """Places, each with its rows in lists of at most ROWS_OF_A_LIST; lists are dealt to all tasks, as a small file is one task otherwise."""
    ordered = df.sortWithinPartitions(*place, F.xxhash64(*df.columns))
    blocks = ordered.withColumn("_block", F.floor(F.monotonically_increasing_id() / ROWS_OF_A_LIST))
    dealt = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place, "_block")
    rest = [c for c in df.columns if c not in place]
    return dealt.groupBy(*place, "_block").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_block")


def within_miles(left: DataFrame, right: DataFrame, miles: float, on: list[str] | None = None, lat: str = "lat", lon: str = "lon", digits: int | None = None) -> DataFrame:
    """Pairs at most `miles` apart, with left_/right_ columns and `miles` (rounded to `digits` where given).

    Both sides are put into cells by latitude band and longitude; the right side
    is copied to the cells around its own, so the join is on equal cells. Rows of
    one place are joined as lists, so a distance is taken once for two places, and
    pairs, of which there can be many more than rows, are neither shuffled nor
    held. Rows with null coordinates match nothing.
    """
    keys = on or []
    a, b = _side(left, "left", lat, lon), _side(right, "right", lat, lon)
    place = lambda side: [f"{side}_{c}" for c in dict.fromkeys([*keys, lat, lon])]
    near = _near(_listed(a, place("left"), "_left"), _listed(b, place("right"), "_right"), miles, keys, lat, lon)
    if digits is not None:
        near = near.withColumn("miles", F.round("miles", digits))
    pairs = near.withColumn("_left", F.explode("_left")).withColumn("_right", F.explode("_right"))
    fixed = {*place("left"), *place("right")}
    columns = [F.col(f"`{c}`") if c in fixed else F.col(side)[c].alias(c) for side, df in (("_left", a), ("_right", b)) for c in df.columns]
    return pairs.select(*columns, "miles")


def count_within_miles(left: DataFrame, right: DataFrame, key: str, miles: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key, n: rows of `right` at most `miles` from each key's rows; places are paired instead of rows."""
    places = lambda df, side: _side(df, side, lat, lon).groupBy(f"{side}_{lat}", f"{side}_{lon}").agg(F.count("*").alias(f"{side}_n"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = _near(places(left, "left").repartition(parts, f"left_{lat}", f"left_{lon}"), places(right, "right"), miles, [], lat, lon)
    counts = near.groupBy(F.col(f"left_{lat}").alias(lat), F.col(f"left_{lon}").alias(lon)).agg(F.sum("right_n").alias("_n"))
    return left.select(key, lat, lon).join(counts, [lat, lon], "left").groupBy(key).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def in_box(lat: Column, lon: Column, lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


def gazetteer(table: DataFrame, city: str = "city", state: str = "state") -> DataFrame:
    """city and state (folded), lat, lon: the first usable row of each place, lowest coordinates first; an empty gazetteer is an error.

    Coordinate columns may go by latitude, lat, longitude, long, lon or lng, in any case.
    """
    from plinth.sources.io import ContractError

    names = {c.lower(): c for c in table.columns}
    lat, lon = (next((names[n] for n in options if n in names), None) for options in (("lat", "latitude"), ("lon", "long", "lng", "longitude")))
    if lat is None or lon is None:
        raise ContractError("a gazetteer needs latitude and longitude")
    rows = table.select(place_key(F.col(city)).alias("city"), place_key(F.col(state)).alias("state"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropna()
    if rows.isEmpty():
        raise ContractError("the gazetteer has no usable row")
    return rows.groupBy("city", "state").agg(F.min(F.struct("lat", "lon")).alias("_p")).select("city", "state", "_p.*")


def place_key(c: Column) -> Column:
    """Upper case, trimmed, inner runs of white space made one space."""
    return F.upper(F.btrim(F.regexp_replace(c.cast("string"), r"\s+", " ")))


def with_coordinates(df: DataFrame, city: str, state: str, places: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """`df` plus lat, lon and coordinates_via: an override, else the gazetteer's row; what neither has stays null, never a centroid."""
    out = df.withColumns({"_city": place_key(F.col(city)), "_state": place_key(F.col(state))})
    found = []
    for name, table in (("override", overrides), ("gazetteer", places)):
        if table is not None:
            out = out.join(table.select(F.col("city").alias("_city"), F.col("state").alias("_state"), F.struct("lat", "lon").alias(f"_{name}")), ["_city", "_state"], "left")
            found.append(name)
    point = F.coalesce(*[F.col(f"_{n}") for n in found])
    via = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in found])
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("lat", "lon")], point["lat"].alias("lat"), point["lon"].alias("lon"), via.alias("coordinates_via"))
