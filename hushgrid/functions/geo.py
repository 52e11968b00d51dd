"""Plane and sphere: tiles, distances, boxes, polygons, windows of a raster, coordinates as text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .acoustics import round_to

#: Meters: the earth's radius, and what one 1e-7 degree is.
EARTH, E7 = 6_371_008.8, 1e-7
METER_PER_DEGREE = math.pi * EARTH / 180
#: Zoom of the graph's tiles.
TILE_ZOOM = 14
#: Trips: least and most meters, and the margin around one: meters, or a share of its length.
TRIP_LEAST, TRIP_MOST, MARGIN, MARGIN_SHARE = 100.0, 5_000.0, 300.0, 0.4
#: Rows of latitude that polygon edges are filed under, in degrees.
ROW = 0.01


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tile_position(lat: Column | str, lng: Column | str, zoom: int) -> Column:
    """struct(x, y, fx, fy): Web Mercator tile and the place within it, from its north-west corner."""
    n, phi = float(1 << zoom), F.radians(_c(lat))
    x = (_c(lng) + 180) / 360 * n
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n
    return F.struct(F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y"), (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"))


def walk_tile(lng_e7: Column | str, lat_e7: Column | str) -> Column:
    return tile_position(_c(lat_e7) * E7, _c(lng_e7) * E7, TILE_ZOOM)


def great_circle_m(lng1, lat1, lng2, lat2) -> Column:
    """Haversine."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_c(lng2) - _c(lng1)) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def meters_between(lng1, lat1, lng2, lat2) -> Column:
    """Of E7 coordinates, on the plane through the mean latitude."""
    mid = F.radians((_c(lat1) + _c(lat2)) * (E7 / 2))
    return F.hypot((_c(lng2) - _c(lng1)) * F.cos(mid), (_c(lat2) - _c(lat1)).cast("double")) * (E7 * METER_PER_DEGREE)


def squared_offset(lng, lat, lng0, lat0) -> Column:
    """Order of nearness on the plane, in square degrees of latitude."""
    return F.pow((_c(lng) - _c(lng0)) * F.cos(F.radians(_c(lat0))), 2) + F.pow(_c(lat) - _c(lat0), 2)


def corridor(lng1, lat1, lng2, lat2) -> Column:
    """struct(west, south, east, north): the box of a trip with its margin."""
    margin = F.greatest(F.lit(MARGIN), MARGIN_SHARE * great_circle_m(lng1, lat1, lng2, lat2))
    d_lat = margin / METER_PER_DEGREE
    d_lng = d_lat / F.cos(F.radians((_c(lat1) + _c(lat2)) / 2))
    return F.struct(
        (F.least(_c(lng1), _c(lng2)) - d_lng).alias("west"), (F.least(_c(lat1), _c(lat2)) - d_lat).alias("south"),
        (F.greatest(_c(lng1), _c(lng2)) + d_lng).alias("east"), (F.greatest(_c(lat1), _c(lat2)) + d_lat).alias("north"),
    )


def trip_screen(meters: Column | str) -> Column:
    return F.when(_c(meters) > TRIP_MOST, "too-far").when(_c(meters) < TRIP_LEAST, "too-close").otherwise("ok")


def tiles_of(box: Column | str, zoom: int = TILE_ZOOM) -> Column:
    """array<struct<x, y>> of the tiles that a box overlaps."""
    b = _c(box)
    nw, se = tile_position(b["north"], b["west"], zoom), tile_position(b["south"], b["east"], zoom)
    rows = F.sequence(nw["y"], se["y"])
    return F.flatten(F.transform(F.sequence(nw["x"], se["x"]), lambda x: F.transform(rows, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def polygon_edges(rings: DataFrame) -> DataFrame:
    """Edges (poly_id, ax, ay, bx, by) of rings (poly_id, ring array<array<double>>, closed), one row for each. A polygon
    has many rings: holes, and the parts of a multipolygon."""
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    e = rings.select("poly_id", F.explode(pairs).alias("e"))
    return e.select("poly_id", F.col("e.a")[0].alias("ax"), F.col("e.a")[1].alias("ay"), F.col("e.b")[0].alias("bx"), F.col("e.b")[1].alias("by"))


#: Columns of tiles that a run is filed under together, and how far beyond its ends an edge counts as touching a tile. The
#: grid's origin is such that lines between round coordinates don't meet its corners.
STRIP, TOUCH = 64, 1e-9
LNG, LAT = 0.00314159265358979, 0.00271828182845905


def _tile_no(x: Column | str, origin: float) -> Column:
    return F.floor((_c(x) - origin) / ROW)


def _tile_start(no: Column | str, origin: float) -> Column:
    return origin + _c(no) * ROW


def _x_at(y: Column) -> Column:
    """Where an edge has the latitude y; null on level edges."""
    return (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax")


def _straddles(a: str, b: str, at: Column) -> Column:
    """Of an edge's two ends the lower counts and the upper doesn't."""
    return (F.col(a) > at) != (F.col(b) > at)


def tile_index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(border, runs) of polygons (poly_id, ax, ay, bx, by), which needs all edges of their rings.

    border: the edges by the tiles (row, col) that they touch, with `odd`: how many edges lie east of the tile's
    south-eastern corner, odd or even. runs: stretches c1 to c2 of tiles of a row that lie inside, once for each strip of
    STRIP columns that they touch. Tiles in neither are outside. What is counted is counted for each tile first, so a ring along one
    latitude is spread over its tiles.
    """
    north = F.greatest("ay", "by")
    e = edges.withColumn("row", F.explode(F.sequence(_tile_no(F.least("ay", "by") - TOUCH, LAT), _tile_no(north + TOUCH, LAT))))
    south, over = _tile_start("row", LAT), _tile_start(F.col("row") + 1, LAT)
    lo, hi = F.greatest(F.least("ay", "by"), south), F.least(north, over)
    ends = [F.coalesce(_x_at(F.least(lo, hi)), F.col("ax")), F.coalesce(_x_at(F.greatest(lo, hi)), F.col("bx"))]
    # An edge that only comes close to a row reaches no farther than its ends.
    inner = [F.least(F.greatest(x, F.least("ax", "bx")), F.greatest("ax", "bx")) for x in ends]
    east = F.when(_straddles("ay", "by", south), F.ceil((_x_at(south) - LNG) / ROW) - 1)
    touched = e.withColumn("crosses", east).withColumn("col", F.explode(F.sequence(_tile_no(F.least(*inner) - TOUCH, LNG), _tile_no(F.greatest(*inner) + TOUCH, LNG))))
    n = touched.groupBy("poly_id", "row", "col").agg(F.sum(F.when(F.col("crosses") == F.col("col"), 1).otherwise(0)).alias("n"))
    w = Window.partitionBy("poly_id", "row").orderBy(F.desc("col"))  # a row for each tile of the border
    beyond = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("beyond", beyond).withColumn("west", F.lead("col").over(w))
    border = touched.join(n.select("poly_id", "row", "col", ((F.col("beyond") - F.col("n")) % 2 == 1).alias("odd")), ["poly_id", "row", "col"])
    gap = n.where((F.col("beyond") % 2 == 1) & (F.col("west") < F.col("col") - 1)).select("poly_id", "row", (F.col("west") + 1).alias("c1"), (F.col("col") - 1).alias("c2"))
    runs = gap.withColumn("strip", F.explode(F.sequence(F.floor(F.col("c1") / STRIP), F.floor(F.col("c2") / STRIP))))
    return border.select("poly_id", "row", "col", "odd", "ax", "ay", "bx", "by"), runs


def containing(points: DataFrame, edges: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, poly_id) of points (key, lng, lat) inside polygons: an even number of edges to the east is outside, over all of a
    polygon's rings. edges: all of the rings, as polygon_edges gives them. Points without a key or a place are in none.

    Only points in tiles that a border runs through meet edges, and only those of their tile: what lies east of a point is
    what lies east of the tile's corner, but for edges that cross the way from there, up the tile's eastern side and
    west to the point. Points in other tiles meet runs of tiles by equality on row and strip.
    """
    border, runs = tile_index(edges)
    p = points.where(F.col(key).isNotNull() & F.col("lng").isNotNull() & F.col("lat").isNotNull()).select(key, "lng", "lat", _tile_no("lat", LAT).alias("row"), _tile_no("lng", LNG).alias("col"))
    within = p.withColumn("strip", F.floor(F.col("col") / STRIP)).join(runs, ["row", "strip"]).where("col BETWEEN c1 AND c2").select(key, "poly_id")
    side = _tile_start(F.col("col") + 1, LNG)
    height = (F.col("by") - F.col("ay")) * (side - F.col("ax")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0)) + F.col("ay")
    up = _straddles("ax", "bx", side) & (height > _tile_start("row", LAT)) & (height <= F.col("lat"))
    x = _x_at(F.col("lat"))
    across = _straddles("ay", "by", F.col("lat")) & (F.col("lng") < x) & (x <= side)
    crossed = F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(across, F.lit(False)).cast("int")
    met = p.join(border, ["row", "col"]).groupBy(key, "lng", "lat", "poly_id").agg(F.sum(crossed).alias("n"), F.first("odd").alias("odd"))
    near = met.where((F.col("n") + F.col("odd").cast("int")) % 2 == 1).select(key, "poly_id")
    return within.unionByName(near).distinct()


def inside_any(points: DataFrame, edges: DataFrame, key: str = "point_id") -> DataFrame:
    """points with `inside`: whether any polygon holds them; the polygons' union."""
    found = containing(points, edges, key).select(key).distinct().withColumn("inside", F.lit(True))
    return points.join(found, key, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def boxes_around(ring_points: DataFrame) -> DataFrame:
    """(raster, west, south, east, north) around rings (raster, seq, lng, lat): longitudes are made continuous, and a
    box over the antimeridian is cut in two."""
    w = Window.partitionBy("raster").orderBy("seq")
    turn = F.coalesce(F.floor((F.lag("lng").over(w) - F.col("lng")) / 360 + 0.5), F.lit(0))
    flat = ring_points.withColumn("turn", turn).withColumn("x", F.col("lng") + 360 * F.sum("turn").over(w))
    box = flat.groupBy("raster").agg(F.min("x").alias("west"), F.min("lat").alias("south"), F.max("x").alias("east"), F.max("lat").alias("north"))
    whole = lambda w, e: F.struct(w.alias("west"), F.col("south"), e.alias("east"), F.col("north"))
    west, east = F.col("west"), F.col("east")
    parts = (
        F.when(east > 180, F.array(whole(west, F.lit(180.0)), whole(F.lit(-180.0), east - 360)))
        .when(west < -180, F.array(whole(west + 360, F.lit(180.0)), whole(F.lit(-180.0), east)))
        .otherwise(F.array(whole(west, east)))
    )
    return box.select("raster", F.explode(parts).alias("b")).select("raster", "b.*")


def windows_over(boxes: DataFrame, margin: float = 0.01) -> DataFrame:
    """(lng, lat, rasters): the one-degree windows that any box touches once widened, with their rasters in order."""
    lo = lambda c: F.floor(F.col(c) - margin)
    hi = lambda c: F.ceil(F.col(c) + margin) - 1
    lngs = F.sequence(F.greatest(lo("west"), F.lit(-180)), F.least(hi("east"), F.lit(179)))
    lats = F.sequence(F.greatest(lo("south"), F.lit(-90)), F.least(hi("north"), F.lit(89)))
    each = boxes.withColumn("lng", F.explode(lngs)).withColumn("lat", F.explode(lats))
    return each.groupBy("lng", "lat").agg(F.sort_array(F.collect_set("raster")).alias("rasters"))


def format_lng_lat(lng, lat) -> Column:
    return F.concat_ws(",", F.format_string("%.6f", round_to(lng, 6)), F.format_string("%.6f", round_to(lat, 6)))


def parse_lng_lat(text: Column | str) -> Column:
    """struct(lng, lat), or null if malformed or out of range."""
    c = F.when(_c(text).rlike(r"^-?\d+(\.\d+)?,-?\d+(\.\d+)?$"), _c(text))
    lng, lat = F.split(c, ",")[0].try_cast("double"), F.split(c, ",")[1].try_cast("double")
    return F.when((F.abs(lng) <= 180) & (F.abs(lat) <= 90), F.struct(lng.alias("lng"), lat.alias("lat")))
