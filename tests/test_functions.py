"""Scalar functions, cells, plane geometry: goldens."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.functions import acoustics as ac, cells as ce, geo, hexgrid


def one(spark, col, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


@pytest.mark.parametrize("levels, laeq", [([60.0, 80.0], 77.03), ([55.0] * 4, 55.0)])
def test_energy_average(spark, levels, laeq):
    df = spark.createDataFrame([(v,) for v in levels], "db double")
    assert df.agg(ac.energy_avg("db")).first()[0] == pytest.approx(laeq, abs=0.01)


def test_summary(spark):
    rows = [("a", float(i * 37 % 101)) for i in range(101)] + [("b", 40.0), ("b", 50.0)] + [("c", 50.0)] * 240 + [("d", 63.0)]
    got = {r.s: r for r in ac.summarize(spark.createDataFrame(rows, "s string, db_spl double"), "s").collect()}
    assert (got["a"].l10, got["a"].l90) == (90, 10)
    assert (got["b"].l10, got["b"].l90, got["b"].spikiness) == (pytest.approx(49), pytest.approx(41), pytest.approx(8))
    assert got["c"].duration_sec == 30
    assert (got["d"].laeq, got["d"].lamax, got["d"].l10, got["d"].l90, got["d"].duration_sec) == (pytest.approx(63), 63, 63, 63, 0.125)


@pytest.mark.parametrize("level, label", [(30.0, "Very quiet"), (44.9, "Very quiet"), (45.0, "Quiet"), (54.9, "Quiet"), (55.0, "Moderate"), (64.9, "Moderate"), (65.0, "Loud"), (74.9, "Loud"), (75.0, "Very loud"), (110.0, "Very loud")])
def test_bands(spark, level, label):
    assert one(spark, ac.loudness_band("v")["label"], v=level) == label


def test_rounding_goes_up(spark):
    assert [one(spark, ac.round_to("v", 0), v=v) for v in (-0.5, 0.5, 1.5, -1.5)] == [0, 1, 2, -1]
    assert one(spark, ac.round_to("v", 1), v=61.26) == pytest.approx(61.3)


def test_cell_algebra(spark):
    assert one(spark, ce.parent("c", 5), c="8a2830828747fff") == "85283083fffffff"
    assert one(spark, ce.resolution("c"), c="8a2830828747fff") == 10
    assert one(spark, ce.is_block("c"), c="8a2830828747fff") is True
    for bad in ("not-a-cell", "8928308280fffff", "8a2830828740fff", "8a2830828747ff", "8af430828747fff"):
        assert one(spark, ce.is_block("c"), c=bad) is False, bad
    assert one(spark, ce.is_valid("c"), c="8928308280fffff") is True
    assert one(spark, ce.is_valid("c"), c="81083ffffffffff") is True
    assert one(spark, ce.is_valid("c"), c="81087ffffffffff") is False  # the deleted child of a pentagon
    first, last = ce.region_range(F.lit("85283083fffffff"))
    assert one(spark, first) == "8a2830800007fff" and one(spark, last) == f"{0x8a2830800007fff | 0o66666 << 15:x}"


def test_children(spark):
    assert one(spark, ce.children_size(F.lit("85283083fffffff"), 5, 10)) == 16807
    assert one(spark, ce.children_size(F.lit("80 is no cell"), 5, 10)) == 16807
    assert one(spark, ce.children_size(F.lit("8009fffffffffff"), 0, 1)) == 6


def test_grid_goldens():
    assert [f"{c:x}" for c in hexgrid.cell_of(np.array([37.78005, 37.7800839]), np.array([-122.417, -122.416]), 10)][0] == "8a2830828757fff"
    assert f"{hexgrid.cell_of(np.array([37.77]), np.array([-122.42]), 5)[0]:x}" == "85283083fffffff"
    assert hexgrid.regions_in(-122.424, 37.766, -122.404, 37.774) == ["85283083fffffff"]
    # Numbers of the pentagons, a fixed property of the grid, come out of the derived base cells.
    assert tuple(np.flatnonzero(hexgrid._base_cells()["pentagon"])) == ce.PENTAGONS


def test_grid_round_trips():
    rng = np.random.default_rng(3)
    lat, lng = rng.uniform(37.2, 38.2, 2000), rng.uniform(-123, -121.8, 2000)
    for res in (5, 9, 10):
        cells = hexgrid.cell_of(lat, lng, res)
        y, x = hexgrid.cell_center(cells)
        assert (hexgrid.cell_of(y, x, res) == cells).all()
    ring = hexgrid.cell_boundary(cells[:50])
    assert ring.shape == (50, 7, 2) and (ring[:, 0] == ring[:, 6]).all()
    assert abs(ring - np.stack([lng[:50], lat[:50]], -1)[:, None]).max() < 0.003
    parents = hexgrid.cell_of(lat, lng, 10)
    inside = (parents & ~np.int64(15 << 52) | np.int64(9 << 52) | np.int64((1 << 18) - 1)) == hexgrid.cell_of(lat, lng, 9)
    assert inside.mean() > 0.8  # a child's edge may stick out of its parent
    assert hexgrid.cell_of(np.array([np.nan]), np.array([1.0]), 10)[0] == 0


def test_grid_distance():
    a = hexgrid.cell_of(np.array([37.7651]), np.array([-122.4196]), 10)
    y, x = hexgrid.cell_center(a)
    north = hexgrid.cell_of(y + 0.00125, x, 10)
    assert hexgrid.grid_distance(a, a)[0] == 0 and hexgrid.grid_distance(a, north)[0] in (1, 2)
    assert hexgrid.grid_distance(a, north)[0] == hexgrid.grid_distance(north, a)[0]


def test_tiles(spark):
    t = one(spark, geo.tile_position(F.lit(37.7651), F.lit(-122.4196), 12))
    assert (t.x, t.y) == (655, 1583)
    t = one(spark, geo.tile_position(F.lit(0.0), F.lit(0.0), 1))
    assert (t.x, t.y, t.fx, t.fy) == (1, 1, 0, 0)
    t = one(spark, geo.walk_tile(F.lit(-1224180000), F.lit(377800000)))
    assert (t.x, t.y) == (2620, 6332)
    assert one(spark, geo.walk_tile(F.lit(-1224180000), F.lit(377900000))).y == 6331


def test_polygon_with_hole(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    rings = spark.createDataFrame([("p", square(0.0, 100.0)), ("p", square(40.0, 60.0))], "poly_id string, ring array<array<double>>")
    points = spark.createDataFrame([(1, 20.0, 20.0), (2, 50.0, 50.0), (3, 120.0, 50.0)], "point_id long, lng double, lat double")
    assert [r.point_id for r in geo.containing(points, geo.polygon_edges(rings)).collect()] == [1]


@pytest.mark.parametrize("res", [0, 1, 2, 4, 5, 10])
def test_cells_of_the_whole_globe(res):
    """A million points lie near their cell's center, and the center in the cell; there are as many cells as there should be."""
    rng = np.random.default_rng(res)
    n = 1_000_000 if res == 10 else 300_000
    lat, lng = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    cells = hexgrid.cell_of(lat, lng, res)
    y, x = hexgrid.cell_center(cells)
    assert (hexgrid.cell_of(y, x, res) == cells).all()
    near = (hexgrid._vector(*np.radians([y, x])) * hexgrid._vector(*np.radians([lat, lng]))).sum(1)
    assert np.arccos(np.clip(near, -1, 1)).max() < 0.75 / 7 ** (res / 2)
    if res <= 2:
        assert len(np.unique(cells)) == 2 + 120 * 7**res
    five = np.isin((cells >> 45) & 127, ce.PENTAGONS)
    lead = np.zeros(n, np.int64)
    for r in range(res, 0, -1):
        digit = (cells >> (3 * (15 - r))) & 7
        lead = np.where(digit > 0, digit, lead)
    assert not (five & (lead == 1)).any()  # pentagons have no such branch


def test_distances_across_pentagons(spark):
    """Against a search over neighbours, which are mutual: five around a pentagon, six around all others."""
    for res in (3, 5):
        pentagons = np.array([(1 << 59) | (res << 52) | (c << 45) | int("0" * res + "7" * (15 - res), 8) for c in ce.PENTAGONS], np.int64)
        for p in pentagons[[0, 1, 5, 11]]:
            around, ring = {}, {int(p)}
            for _ in range(7):
                new = np.array(sorted(ring - around.keys()), np.int64)
                around |= {int(c): set(n) - {int(c)} for c, n in zip(new, hexgrid.neighbours(new).tolist(), strict=True)}
                ring = set().union(*around.values())
            assert all(len(n) == (5 if c == p else 6) for c, n in around.items())
            assert all(c in around[n] for c, ns in around.items() for n in ns if n in around)
            inner = [c for c in around if around[c] <= around.keys()]
            for start in inner[:40:3]:
                steps, edge = {start: 0}, [start]
                for k in range(1, 4):
                    edge = sorted({n for c in edge for n in around.get(c, ())} - steps.keys())
                    steps |= dict.fromkeys(edge, k)
                some = np.array(sorted(steps), np.int64)
                assert hexgrid.grid_distance(np.full(len(some), start), some).tolist() == [steps[int(c)] for c in some]
    far = hexgrid.grid_distance(pentagons[:1], pentagons[1:2])
    assert far[0] > 4


def even_odd(rings, lng, lat):
    """Edges east of a point, over all rings; of an edge's ends the lower counts."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            n += (ay > lat) != (by > lat) and lng < (bx - ax) * (lat - ay) / (by - ay) + ax
    return n % 2 == 1


def test_points_in_polygons(spark):
    """Against the rule itself: rings of any shape, holes, overlaps, level and upright sides, corners on the grid and
    outside it, points on corners and sides too."""
    rnd = random.Random(7)
    polygons = {}
    for k in range(14):
        cx, cy, size = rnd.uniform(-122.6, -122.3), rnd.uniform(37.6, 37.9), rnd.choice([0.003, 0.02, 0.15])
        rings = []
        for _ in range(rnd.choice([1, 1, 2, 3])):
            n = rnd.randrange(3, 12)
            at = [(cx + rnd.uniform(0.2, 1) * size * math.cos(2 * math.pi * i / n), cy + rnd.uniform(0.2, 1) * size * math.sin(2 * math.pi * i / n)) for i in range(n)]
            if k % 3 == 0:
                at = [(round(x, 2), round(y, 2)) for x, y in at]
            rings.append([*at, at[0]])
        polygons[f"p{k}"] = rings
    polygons["box"] = [[(-122.5, 37.7), (-122.4, 37.7), (-122.4, 37.8), (-122.5, 37.8), (-122.5, 37.7)], [(-122.46, 37.74), (-122.44, 37.74), (-122.44, 37.76), (-122.46, 37.76), (-122.46, 37.74)]]
    polygons["south"] = [[(-0.05, -0.05), (0.05, -0.03), (0.01, 0.05), (-0.05, -0.05)]]
    points = [(rnd.uniform(-122.65, -122.25), rnd.uniform(37.55, 37.95)) for _ in range(3000)] + [(rnd.uniform(-0.06, 0.06), rnd.uniform(-0.06, 0.06)) for _ in range(300)]
    points += [(round(x, 2), round(y, 2)) for x, y in points[:800]] + [c for rings in polygons.values() for ring in rings for c in ring]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(None, -122.45, 37.72), (-1, None, 37.72)], "point_id long, lng double, lat double")
    rings = spark.createDataFrame([(p, [list(c) for c in r]) for p, rs in polygons.items() for r in rs], "poly_id string, ring array<array<double>>")
    got = {(r.point_id, r.poly_id) for r in geo.containing(df, geo.polygon_edges(rings)).collect()}
    want = {(k, p) for k, (x, y) in enumerate(points) for p, rs in polygons.items() if even_odd(rs, x, y)}
    assert got == want and len(want) > 1000, [(x, points[x[0]], polygons[x[1]]) for x in sorted(got ^ want)[:3]]
    assert geo.containing(df.limit(0), geo.polygon_edges(rings)).count() == 0 == geo.containing(df, geo.polygon_edges(rings.limit(0))).count()


def test_ring_along_one_latitude(spark):
    """A ring of 100,000 edges within some rows: no tile has many, and points inside don't meet edges."""
    n = 50_000
    line = lambda y: [(-120 + 10 * i / n, y + 0.001 * math.sin(i)) for i in range(n + 1)]
    ring = [*line(40.0), *reversed(line(40.03)), line(40.0)[0]]
    edges = geo.polygon_edges(spark.createDataFrame([("long", [list(c) for c in ring])], "poly_id string, ring array<array<double>>")).repartition(4)
    border, runs = geo.tile_index(edges)
    assert max(r["count"] for r in border.groupBy("row", "col").count().collect()) < 300 and runs.count() < 100
    rnd = random.Random(1)
    points = [(rnd.uniform(-120.1, -109.9), rnd.uniform(39.995, 40.035)) for _ in range(400)]
    got = {r.point_id for r in geo.containing(spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "point_id long, lng double, lat double"), edges).collect()}
    assert got == {k for k, p in enumerate(points) if even_odd([ring], *p)}


def test_windows_and_boxes(spark):
    b = spark.createDataFrame([("CT", -73.82, 40.69, -71.6, 42.32), ("RI", -72.005, 41.08, -70.96, 42.09)], "raster string, west double, south double, east double, north double")
    w = {(r.lng, r.lat): r.rasters for r in geo.windows_over(b).collect()}
    assert len(w) == 11 and min(w) == (-74, 40) and w[-74, 40] == ["CT"] and w[-72, 41] == ["CT", "RI"] == w[-73, 41] and w[-71, 42] == ["RI"]
    ring = [(172.9, 51.6), (179.0, 60.0), (-179.0, 69.0), (-117.4, 60.0), (-150.0, 51.6), (172.9, 51.6)]
    p = spark.createDataFrame([("AK", i, x, y) for i, (x, y) in enumerate(ring)], "raster string, seq int, lng double, lat double")
    got = sorted((r.west, r.south, r.east, r.north) for r in geo.boxes_around(p).collect())
    assert got == [(pytest.approx(-180), 51.6, pytest.approx(-117.4), 69), (pytest.approx(172.9), 51.6, pytest.approx(180), 69)]
    assert geo.windows_over(geo.boxes_around(p)).count() == 71 * 19


def test_text(spark):
    assert one(spark, geo.format_lng_lat(F.lit(-122.4196), F.lit(37.7651))) == "-122.419600,37.765100"
    assert tuple(one(spark, geo.parse_lng_lat(F.lit("-122.4196,37.7651")))) == (-122.4196, 37.7651)
    for bad in ("", "1", "1,2,3", "a,b", "181,0", "0,91", " 1,2"):
        assert one(spark, geo.parse_lng_lat(F.lit(bad))) is None


def test_regions_of_many_boxes_at_once():
    """Boxes of several sizes, all over the globe, as one by one; each region's points in the box are in its list."""
    rng = np.random.default_rng(3)
    size, at = rng.choice([0.01, 0.05, 0.3, 1.1], (300, 2)), np.stack([rng.uniform(-179, 178, 300), rng.uniform(-80, 78, 300)], 1)
    boxes = np.concatenate((at, at + size), 1)
    boxes[7, 2] = np.nan
    got = hexgrid.regions_of(boxes)
    assert got[7] == [] and got[:7] + got[8:] == [hexgrid.regions_in(*b) for b in np.delete(boxes, 7, 0)] and hexgrid.regions_of(np.zeros((0, 4))) == []
    for (west, south, east, north), found in zip(boxes[8:60], got[8:60], strict=True):
        lng, lat = (x.ravel() for x in np.meshgrid(np.linspace(west, east, 9), np.linspace(south, north, 9)))
        assert {f"{c:015x}" for c in hexgrid.cell_of(lat, lng, 5)} <= set(found) and found == sorted(set(found))
