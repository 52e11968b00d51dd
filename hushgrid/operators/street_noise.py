"""Modeled street noise: pixels to blocks, blocks to areas, states of a cell, map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import acoustics as ac, cells as ce, geo
from .venues import cell_boundary, cell_center, cell_of

#: Modeled levels begin here.
FLOOR = 45.0
# The zooms at which each resolution is drawn, and those from which measured blocks and blocks are.
ZOOMS = {5: (3, 5), 6: (6, 7), 7: (8, 8), 8: (9, 9), 9: (10, 11), 10: (12, 12)}
MEASURED_ZOOM, BLOCK_ZOOM = 10, 12
NO_DATA = 1e30


def block_levels(pixels: DataFrame, cell: str | None = None) -> DataFrame:
    """(cell, laeq): energy mean of the pixels (lat, lng, db) of each block, over all rasters. The cell is computed
    in the scan's stage and the means are combined before the shuffle."""
    p = pixels if cell else pixels.withColumn("cell", cell_of("lat", "lng", F.lit(ce.BLOCK)))
    return p.groupBy("cell").agg(ac.energy_avg("db").alias("laeq"))


def area_levels(blocks: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(res, cell, laeq) for resolutions 9 to 5: energy of the blocks present over all blocks of the area, absent
    ones being silent. Each level is summed from the one below; the floor drops areas only from the result, as they
    still count in their parents."""
    sums = blocks.select(ce.parent_number(ce.number("cell"), 9).alias("n"), ac.energy_of("laeq").alias("energy"))
    out = None
    for res in range(9, 4, -1):
        sums = sums.select(ce.parent_number(F.col("n"), res).alias("n"), "energy").groupBy("n").agg(F.sum("energy").alias("energy"))
        here = sums.select(F.lit(res).alias("res"), ce.text("n").alias("cell"), ac.level_of(F.col("energy") / ce.children_size(ce.text("n"), res, ce.BLOCK)).alias("laeq"))
        out = here if out is None else out.unionByName(here)
    return out.where(F.col("laeq") >= floor)


def street_level(cells: DataFrame, blocks: DataFrame, shore: DataFrame, located: bool = False) -> DataFrame:
    """cells with kind and laeq24h: modeled, below-floor (inside the shoreline) or not-covered.

    The polygon test runs on the distinct cells without a level. With `located` the cells have lat and lng of their
    center already; a cell with several is inside if any of them is. shore: polygon edges.
    """
    joined = cells.join(blocks.select("cell", F.col("laeq").alias("laeq24h")), "cell", "left")
    missing = joined.where("laeq24h IS NULL").select("cell", *(["lat", "lng"] if located else [])).distinct()
    if not located:
        missing = missing.withColumn("at", cell_center("cell")).select("cell", "at.lat", "at.lng")
    inside = geo.containing(missing, shore, "cell").select("cell").distinct().withColumn("inside", F.lit(True))
    kind = F.when(F.col("laeq24h").isNotNull(), "modeled").when(F.col("inside"), "below-floor").otherwise("not-covered")
    return joined.join(inside, "cell", "left").withColumn("kind", kind).drop("inside")


def cell_cards(measured: DataFrame, street: DataFrame) -> DataFrame:
    """Each cell's measured level beside its street level, never averaged; cells that are neither measured nor
    covered drop. measured: (cell, laeq, count); street: (cell, kind, laeq24h)."""
    both = measured.join(street.select("cell", "kind", "laeq24h"), "cell", "full")
    both = both.withColumn("kind", F.coalesce("kind", F.lit("not-covered")))
    return both.where(F.col("laeq").isNotNull() | (F.col("kind") != "not-covered"))


def block_level(measured: DataFrame, street: DataFrame) -> DataFrame:
    """(cell, kind, level): measured wins over the street level, whatever its count."""
    j = street.join(measured.select("cell", F.col("laeq").alias("m")), "cell", "left")
    return j.select("cell", F.when(F.col("m").isNotNull(), "measured").otherwise(F.col("kind")).alias("kind"), F.coalesce("m", "laeq24h").alias("level"))


def level_db(kind: Column | str, level: Column | str) -> Column:
    """What statistics count: the floor where below it, null where not covered."""
    k, v = (F.col(x) if isinstance(x, str) else x for x in (kind, level))
    return F.when(k == "below-floor", F.lit(FLOOR)).when(k != "not-covered", v)


def encode_level(kind: Column | str, level: Column | str) -> Column:
    """Tenths of a decibel; 0 is below the floor and 65535 not covered. A level that would read back as one of these, or
    doesn't fit two bytes, is an error when it runs."""
    k, v = (F.col(x) if isinstance(x, str) else x for x in (kind, level))
    code = ac.round_to(v * 10)
    sound = F.when(code.between(1, 65534), code.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no code for a level of "), F.coalesce(v.cast("string"), F.lit("null")))).cast("int"))
    return F.when(k == "below-floor", 0).when(k == "not-covered", 65535).otherwise(sound)


def decode_level(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    kind = F.when(c == 0, "below-floor").when(c == 65535, "not-covered").otherwise("modeled")
    return F.struct(kind.alias("kind"), F.when(kind == "modeled", c / 10).alias("laeq24h"))


def noise_features(cells: DataFrame, res: Column | str) -> DataFrame:
    """One GeoJSON line for each (cell, laeq): a closed ring rounded to six decimals. A resolution without zooms is
    an error."""
    r = F.col(res) if isinstance(res, str) else res
    zooms = None
    for k, (lo, hi) in ZOOMS.items():
        z = F.struct(F.lit("noise").alias("layer"), F.lit(lo).alias("minzoom"), F.lit(hi).alias("maxzoom"))
        zooms = F.when(r == k, z) if zooms is None else zooms.when(r == k, z)
    zooms = zooms.otherwise(F.raise_error(F.lit("no zoom for this resolution")))
    ring = F.transform(cell_boundary("cell"), lambda p: F.transform(p, lambda x: F.floor(x * 1e6 + 0.5) / 1e6))
    feature = F.struct(
        F.lit("Feature").alias("type"), zooms.alias("tippecanoe"),
        F.struct(F.col("cell"), ac.round_to("laeq", 1).alias("laeq")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return cells.select("cell", F.to_json(feature).alias("value"))


def measured_features(cells: DataFrame) -> DataFrame:
    """GeoJSON lines of measured cells (cell, laeq, count): closed ring, level and count, nothing of who measured."""
    g = F.struct(F.lit("Polygon").alias("type"), F.array(cell_boundary("cell")).alias("coordinates"))
    f = F.struct(F.lit("Feature").alias("type"), F.struct("cell", "laeq", "count").alias("properties"), g.alias("geometry"))
    return cells.select("cell", F.to_json(f).alias("value"))


def map_cells(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks and areas as one set with their zooms."""
    z = F.create_map(*[x for k, (lo, hi) in ZOOMS.items() for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    both = blocks.select(F.lit(ce.BLOCK).alias("res"), "cell", "laeq").unionByName(areas)
    return both.withColumn("z", z[F.col("res")]).select("res", "cell", "laeq", F.col("z.lo").alias("min_zoom"), F.col("z.hi").alias("max_zoom"))


def coverage_features(polygons: DataFrame) -> DataFrame:
    """The modeled area (geometry: GeoJSON text) as features of block tiles only."""
    head = F.lit(f'{{"type":"Feature","tippecanoe":{{"layer":"coverage","minzoom":{BLOCK_ZOOM},"maxzoom":{BLOCK_ZOOM}}},"geometry":')
    return polygons.select(F.concat(head, "geometry", F.lit(',"properties":{}}')).alias("value"))


def view_rules(zoom: Column | str, regions: Column | str) -> Column:
    """struct(res, measured, taps): what a view of some regions shows: the modeled resolution (null below the first),
    whether it asks for measured blocks, and whether blocks answer."""
    z, r = (F.col(x) if isinstance(x, str) else x for x in (zoom, regions))
    res = None
    for k, (lo, _) in sorted(ZOOMS.items(), reverse=True):
        res = F.when(z >= lo, k) if res is None else res.when(z >= lo, k)
    return F.struct(res.alias("res"), ((z >= MEASURED_ZOOM) & r.between(1, ce.MAX_REGIONS)).alias("measured"), (z >= BLOCK_ZOOM).alias("taps"))


def footprint_points(rasters: DataFrame, steps: int = 64) -> DataFrame:
    """(raster, seq, px, line): points along the edge of rasters (raster, width, height), `steps` to a side, clockwise
    from the first pixel. Turning them into degrees is the projection's work."""
    side, k = F.floor(F.col("seq") / steps), F.col("seq") % steps / steps
    p = rasters.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4 * steps - 1))))
    x = F.when(side == 0, k).when(side == 1, 1.0).when(side == 2, 1 - k).otherwise(0.0)
    y = F.when(side == 0, 0.0).when(side == 1, k).when(side == 2, 1.0).otherwise(1 - k)
    return p.select("raster", "seq", (x * F.col("width")).alias("px"), (y * F.col("height")).alias("line"))
