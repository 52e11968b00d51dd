"""Readers and writers of text and JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cells as ce
from ..functions.acoustics import is_finite, round_to
from ..operators.street_noise import NO_DATA

READING = (
    "user_id string, client_id string, cell string, at timestamp, saved_at timestamp, summary struct<laeq double, lamax double, l10 double, l90 double, duration_sec double>, "
    "calibration struct<model string, offset_db double, id string>, visit struct<osm_id string, hour double>"
)


def read_readings(spark: SparkSession, path: str, form: str = "parquet", stream: bool = False) -> DataFrame:
    """Submitted readings with their declared schema, at rest or as a stream."""
    return (spark.readStream if stream else spark.read).schema(READING).format(form).load(path)


def parse_pixels(lines: DataFrame, value: str = "value") -> DataFrame:
    """(lng, lat, db) of lines of three numbers; malformed lines, numbers that aren't finite and missing data drop."""
    parts = F.split(F.trim(value), r"\s+")
    p = lines.where(F.size(parts) == 3).select(*(parts[k].try_cast("double").alias(c) for k, c in enumerate(("lng", "lat", "db"))))
    return p.where(is_finite("lng") & is_finite("lat") & is_finite("db") & (F.col("db") <= NO_DATA))


def parse_blocks(lines: DataFrame, value: str = "value") -> DataFrame:
    """(cell, laeq, fault) of lines `cell<TAB>laeq`: fault is cell, level, repeated, or null."""
    parts = F.split(F.col(value), "\t")
    b = lines.select(parts[0].alias("cell"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("laeq"))
    counts = b.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    b = b.join(counts, "cell", "left")
    fault = F.when(F.length("cell") != 15, "cell").when(~is_finite("laeq"), "level").when(F.col("n") > 1, "repeated")
    return b.select("cell", "laeq", fault.alias("fault"))


def good_blocks(lines: DataFrame) -> DataFrame:
    """parse_blocks, with any fault an error when it runs."""
    p = parse_blocks(lines)
    return p.select("cell", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("bad block "), "cell"))).otherwise(F.col("laeq")).alias("laeq"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Sorted by cell over all files."""
    line = F.concat_ws("\t", "cell", F.col("laeq").cast("string"))
    blocks.repartitionByRange("cell").sortWithinPartitions("cell").select(line.alias("value")).write.text(path)


def unescaped(text: Column) -> Column:
    """Text in which a code point's hexadecimal digits between two percent signs stand for the character. The parts between
    percent signs are taken one by one: digits behind an unused sign use it and the next one up."""
    digits = lambda x: (F.length(x) > 0) & (F.length(x) <= 8) & (F.translate(x, "0123456789abcdef", "") == "")
    char = lambda x: F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32")
    start = lambda parts: F.struct(parts[0].alias("done"), F.lit(False).alias("used"), F.lit(1).alias("k"))

    def step(n):
        def take(state, x):
            escape = ~state["used"] & digits(x) & (state["k"] < n - 1)
            more = F.when(escape, char(x)).when(state["used"], x).otherwise(F.concat(F.lit("%"), x))
            return F.struct(F.concat(state["done"], more).alias("done"), escape.alias("used"), (state["k"] + 1).alias("k"))

        return take

    whole = lambda parts: F.aggregate(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), start(parts), step(F.size(parts)), lambda state: state["done"])
    return F.when(F.instr(text, "%") == 0, text).otherwise(ce.let(F.split(text, "%"), whole))


def parse_ways(lines: DataFrame, value: str = "value") -> DataFrame:
    """(way_id, tags, nodes) of object-per-line text: lines `w<id> T<k>=<v>,... Nn<id>x<lng>y<lat>,...`. A node
    without a place has null coordinates; of a repeated tag the last counts."""
    w = lines.where(F.col(value).startswith("w")).select(F.split(value, " ").alias("f"))
    tag = F.filter(F.split(F.substring(F.col("f")[1], 2, 1 << 30), ","), lambda x: F.length(x) > 0)
    ref = F.filter(F.split(F.substring(F.col("f")[2], 2, 1 << 30), ","), lambda x: F.length(x) > 0)
    w = w.select(F.substring(F.col("f")[0], 2, 30).cast("long").alias("way_id"), tag.alias("t"), ref.alias("r"))
    pair = lambda x: F.struct(unescaped(F.substring_index(x, "=", 1)).alias("k"), unescaped(F.coalesce(F.try_element_at(F.split(x, "="), F.lit(2)), F.lit(""))).alias("v"))
    number = lambda x: F.when(F.translate(x, "0123456789.-", "") == "", x.try_cast("double"))
    e7 = lambda x: round_to(number(x) * 1e7).cast("int")

    def node(x: Column) -> Column:
        """n<id>x<lng>y<lat>, where the places may be empty."""
        first, place = F.substring_index(x, "x", 1), F.try_element_at(F.split(x, "x"), F.lit(2))
        lng, lat = F.substring_index(place, "y", 1), F.try_element_at(F.split(place, "y"), F.lit(2))
        whole = x.startswith("n") & lat.isNotNull()
        return F.struct(F.when(whole, F.substring(first, 2, 30).try_cast("long")).alias("id"), F.when(whole, e7(lng)).alias("lng_e7"), F.when(whole, e7(lat)).alias("lat_e7"))

    entries = F.filter(F.transform(F.filter("t", lambda x: F.substring_index(x, "=", 1) != ""), pair), lambda p: p["k"].isNotNull())
    last = lambda e: ce.let(F.array_distinct(F.transform(e, lambda x: x["k"])), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(F.filter(e, lambda x: x["k"] == k), -1)["v"])))
    tags = ce.let(entries, last)
    # Through a generator, so that filters on tags aren't pushed below, where each would parse the line again.
    return w.select(F.inline(F.array(F.struct("way_id", tags.alias("tags"), F.transform("r", node).alias("nodes")))))


def parse_outbox(rows: DataFrame) -> DataFrame:
    """Rows of an outbox in order of `at`: those of a wrong type or an invalid cell drop; a visit that doesn't parse
    is null. Columns are text as stored, visit JSON."""
    number = {c: F.col(c).try_cast("double") for c in ("at", "laeq", "lamax", "l10", "l90", "duration_sec", "offset_db")}
    v = F.from_json("visit", "struct<osmId string, hour double>")
    ok = F.coalesce(v["osmId"].rlike(r"^(node|way|relation)/\d+$") & (v["hour"] == F.floor(v["hour"])) & v["hour"].between(0, 23), F.lit(False))
    visit = F.when(ok, F.struct(v["osmId"].alias("osm_id"), v["hour"].cast("int").alias("hour")))
    typed = rows.withColumns(number | {"visit": visit})
    return typed.where(" AND ".join(f"{c} IS NOT NULL" for c in number) + " AND client_id IS NOT NULL AND model IS NOT NULL").where(ce.is_valid("cell")).orderBy("at")


def parse_coverage(features: DataFrame, value: str = "value") -> DataFrame:
    """Rings (poly_id, ring) of GeoJSON lines whose STATEFP is at most 56; polygons and multipolygons."""
    head = F.from_json(value, "struct<properties: struct<STATEFP: string>, geometry: struct<type: string>>")
    f = features.withColumn("h", head).where(F.col("h.properties.STATEFP").try_cast("int") <= 56)
    poly = F.from_json(value, "struct<geometry: struct<coordinates: array<array<array<double>>>>>")["geometry"]["coordinates"]
    multi = F.from_json(value, "struct<geometry: struct<coordinates: array<array<array<array<double>>>>>>")["geometry"]["coordinates"]
    rings = F.when(F.col("h.geometry.type") == "Polygon", poly).when(F.col("h.geometry.type") == "MultiPolygon", F.flatten(multi))
    return f.select(F.col("h.properties.STATEFP").alias("poly_id"), F.explode(rings).alias("ring"))


def release_name(form: str, osm: str, noise: str) -> dict[str, Column]:
    """Columns to partition an output by, so that releases never mix."""
    return {"format": F.lit(form), "osm_release": F.lit(osm), "noise_release": F.lit(noise)}


def point_features(points: DataFrame, properties: list[str]) -> DataFrame:
    """GeoJSON lines of (lng, lat, properties...)."""
    g = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), g.alias("geometry"))).alias("value"))


def tiles_in(tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Tiles that a box (west, south, east, north) overlaps: two ranges that reach the scan. Missing tiles are left
    out."""
    from ..operators.routes import _tile

    west, south, east, north = box
    (x0, y0), (x1, y1) = _tile(west, north), _tile(east, south)
    return tiles.where(F.col("tile_x").between(x0, x1) & F.col("tile_y").between(y0, y1))
