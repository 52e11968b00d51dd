"""Venues: search results, nearness, hours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import geo, hexgrid

#: Meters and rings around a block's center, venues listed, longest name, days that a saved search is good for.
RADIUS, RINGS, MOST, NAME_LENGTH, FRESH_DAYS = 150.0, 3, 8, 120, 30

ELEMENT = "array<struct<type:string, id:bigint, lat:double, lon:double, center:struct<lat:double, lon:double>, tags:map<string,string>>>"


def kind_of(tags: Column | str = "tags") -> Column:
    t = F.col(tags) if isinstance(tags, str) else tags
    amenity = F.try_element_at(t, F.lit("amenity"))
    office = F.try_element_at(t, F.lit("office"))
    return F.when(amenity.isin("cafe", "library"), amenity).when((amenity == "coworking_space") | (office == "coworking"), F.lit("coworking"))


def parse_search(responses: DataFrame, key: str = "cell", raw: str = "raw") -> DataFrame:
    """(key, osm_id, name, kind, lat, lng) of the usable elements of JSON responses. A response without elements is
    an error."""
    parsed = responses.withColumn("e", F.from_json(raw, f"struct<elements:{ELEMENT}>")["elements"])
    parsed = parsed.withColumn("e", F.when(F.col("e").isNull(), F.raise_error(F.lit("response has no elements"))).otherwise(F.col("e")))
    e = parsed.select(key, F.explode("e").alias("e")).select(key, "e.*")
    out = e.select(
        key, F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_id"), F.trim(F.try_element_at("tags", F.lit("name"))).alias("name"),
        kind_of().alias("kind"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"),
    )
    ok = F.col("osm_id").rlike(r"^(node|way|relation)/\d+$") & F.length("name").between(1, NAME_LENGTH)
    return out.where(ok & F.col("kind").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull())


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]))
def cell_center(cells: pd.Series) -> pd.DataFrame:
    lat, lng = hexgrid.cell_center([int(c, 16) for c in cells])
    return pd.DataFrame({"lat": lat, "lng": lng})


@F.pandas_udf(T.IntegerType())
def grid_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(hexgrid.grid_distance([int(c, 16) for c in a], [int(c, 16) for c in b]), dtype="int32")


@F.pandas_udf(T.StringType())
def cell_of(lat: pd.Series, lng: pd.Series, res: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(lat), dtype=object)
    for r in res.unique():
        m = (res == r).to_numpy()
        found = hexgrid.cell_of(lat[m].to_numpy(float), lng[m].to_numpy(float), int(r))
        out[m] = [f"{c:015x}" if c else None for c in found]
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def cell_boundary(cells: pd.Series) -> pd.Series:
    return pd.Series([r.tolist() for r in hexgrid.cell_boundary([int(c, 16) for c in cells])], dtype=object)


_FACTS = T.StructType([T.StructField("cell", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("lat", "lng")), *(T.StructField(c, T.IntegerType()) for c in ("corners", "steps"))])


@F.pandas_udf(_FACTS)
def cell_facts(lat: pd.Series, lng: pd.Series, to_lat: pd.Series, to_lng: pd.Series) -> pd.DataFrame:
    """A place's block, its center, the points of its closed ring, and the steps to another place's block, all by numbers in one worker:
    functions that stand on each other's results hold a worker each. Null without a place."""
    at, to = (hexgrid.cell_of(y.to_numpy(float), x.to_numpy(float), 10) for y, x in ((lat, lng), (to_lat, to_lng)))
    out = pd.DataFrame({"cell": [None] * len(at), "lat": np.nan, "lng": np.nan, "corners": pd.array([None] * len(at), "Int32"), "steps": pd.array([None] * len(at), "Int32")})
    ok, far = np.flatnonzero(at), np.flatnonzero((at != 0) & (to != 0))
    if len(ok):
        out.loc[ok, "cell"] = [f"{c:015x}" for c in at[ok]]
        out.loc[ok, "lat"], out.loc[ok, "lng"] = hexgrid.cell_center(at[ok])
        out.loc[ok, "corners"] = [len(r) for r in hexgrid.cell_boundary(at[ok])]
    if len(far):
        out.loc[far, "steps"] = hexgrid.grid_distance(at[far], to[far])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def regions_in(west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
    return pd.Series(hexgrid.regions_of(np.stack([c.to_numpy(float) for c in (west, south, east, north)], 1)), dtype=object)


def ranked(near: DataFrame) -> DataFrame:
    """The MOST nearest venues of each cell, as `rank` by squared offset, ties by osm_id. Columns: cell, osm_id, d2."""
    w = Window.partitionBy("cell").orderBy("d2", "osm_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST)


#: Zoom of the tiles that venues and blocks meet in.
NEAR_ZOOM = 17


def nearby(blocks: DataFrame, venues: DataFrame, radius: float = RADIUS, rings: int | None = RINGS) -> DataFrame:
    """(cell, osm_id, meters, d2, rank): venues (osm_id, lat, lng) around blocks (cell, lat, lng of the center).

    Both are filed under tiles, a venue under all that the box around its radius overlaps, so they meet by equality; then
    the distance decides, and with `rings` also the steps between cells. Of the venues at one place only the first MOST can be
    listed, as their distances are equal, and blocks at one place have the same venues, so places meet instead of rows.
    """
    crowd = Window.partitionBy("lat", "lng").orderBy("osm_id")
    v = venues.select("osm_id", "lat", "lng").withColumn("n", F.row_number().over(crowd)).where(F.col("n") <= MOST)
    d_lat = 1.01 * radius / geo.METER_PER_DEGREE  # a little more than the radius; the distance is tested below
    d_lng = F.lit(d_lat) / F.cos(F.radians(F.least(F.abs("lat") + d_lat, F.lit(89.9))))
    box = F.struct((F.col("lng") - d_lng).alias("west"), (F.col("lat") - d_lat).alias("south"), (F.col("lng") + d_lng).alias("east"), (F.col("lat") + d_lat).alias("north"))
    v = v.where("lat IS NOT NULL AND lng IS NOT NULL").select("osm_id", "lat", "lng", F.explode(geo.tiles_of(box, NEAR_ZOOM)).alias("t")).select("osm_id", "lat", "lng", "t.x", "t.y")
    b = blocks.select("cell", F.col("lat").alias("lat0"), F.col("lng").alias("lng0"))
    place = ["lat0", "lng0"] if rings is None else ["cell", "lat0", "lng0"]
    t = geo.tile_position("lat0", "lng0", NEAR_ZOOM)
    met = b.select(*place).distinct().withColumn("t", t).select(*place, "t.x", "t.y").join(v, ["x", "y"])
    met = met.withColumn("meters", geo.great_circle_m("lng", "lat", "lng0", "lat0")).where(F.col("meters") <= radius)
    if rings is not None:
        met = met.withColumn("own", cell_of("lat", "lng", F.lit(10))).where(grid_distance("cell", "own").between(0, rings))
    met = met.withColumn("d2", geo.squared_offset("lng", "lat", "lng0", "lat0"))
    first = met.withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy("d2", "osm_id"))).where(F.col("n") <= MOST)
    return ranked(b.join(first.select(*place, "osm_id", "meters", "d2"), place)).select("cell", "osm_id", "meters", "d2", "rank")


def fresh(searches: DataFrame, now_ms: Column) -> DataFrame:
    return searches.where(now_ms - F.col("fetched_ms") < FRESH_DAYS * 86_400_000)


def format_hour(hour: Column | str) -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    twelve = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.concat(twelve.cast("string"), F.when(h < 12, " am").otherwise(" pm"))
