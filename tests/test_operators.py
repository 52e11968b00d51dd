"""Operators of readings, street noise, the walking graph, routes, the meter and streams."""

from __future__ import annotations

import json
import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushgrid.functions import hexgrid
from hushgrid.operators import meter, ranks, readings as rd, routes, street_noise as sn, venues as ve, walk_graph as wg
from hushgrid.plans import adapters as ad
from hushgrid.sources import text as tx
from hushgrid.streaming import jobs, store

CELL = "8a2830828747fff"
READING = "seq long, user_id long, client_id long, cell string, saved_ms long, at_ms long, duration_sec double, laeq double, lamax double, l10 double, l90 double, model string, offset_db double"


def reading(seq=1, **kw):
    r = dict(seq=seq, user_id=1, client_id=seq, cell=CELL, saved_ms=10**12, at_ms=10**12 - 60_000, duration_sec=30.0, laeq=62.0, lamax=78.0, l10=66.0, l90=55.0, model="iPhone16,1", offset_db=120.0)
    return tuple((r | kw)[c.split()[0]] for c in READING.split(", "))


def test_rejections(spark):
    minute, nan = 60_000, float("nan")
    cases = [({}, None), ({"cell": "not-a-cell"}, "cell"), ({"cell": "8928308280fffff"}, "cell"), ({"cell": None}, "cell"), ({"at_ms": 10**12 + minute}, None), ({"at_ms": 10**12 + 60 * minute}, "time"), ({"duration_sec": 12.5}, "duration"), ({"lamax": 500.0}, "level"), ({"laeq": nan}, "level"), ({"l90": 70.0}, "order"), ({"model": ""}, "model"), ({"model": None}, "model"), ({"offset_db": 0.0}, "offset"), ({"offset_db": nan}, "offset")]
    df = spark.createDataFrame([reading(n, **c) for n, (c, _) in enumerate(cases)], READING)
    got = dict(df.select("seq", rd.rejection_reason()).collect())
    assert [got[n] for n in range(len(cases))] == [r for _, r in cases]


def loop(rows, user, block):
    """The rules one by one."""
    saved, done, out = defaultdict(list), set(), {}
    for seq, u, c, cell, ms in sorted(rows, key=lambda r: (r[4], r[0])):
        if (u, c) in done:
            out[seq] = "duplicate"
            continue
        for key, limit, name in ((("u", u), user, "refused-user"), (("c", cell), block, "refused-block")):
            if sum(t > ms - limit.window_ms for t in saved[key]) >= limit.count:
                out[seq] = name
                break
        else:
            out[seq] = "admitted"
            done.add((u, c))
            saved["u", u].append(ms)
            saved["c", cell].append(ms)
    return out


def test_admission_is_sequential(spark):
    rnd = random.Random(5)
    rows = [(n, rnd.randrange(6), rnd.randrange(60), f"c{rnd.randrange(9)}", rnd.randrange(0, 40_000) // 50 * 50) for n in range(500)]
    user, block = rd.Limit(4, 5_000), rd.Limit(3, 2_000)
    df = spark.createDataFrame(rows, "seq long, user_id long, client_id long, cell string, saved_ms long")
    want = loop(rows, user, block)
    assert {r.seq: r.status for r in rd.admit(df, user, block).collect()} == want
    assert set(want.values()) == {"admitted", "duplicate", "refused-user", "refused-block"}


def test_limits_and_retries(spark):
    hour, now = 3_600_000, 10**12
    schema = "seq long, user_id long, client_id long, cell string, saved_ms long"
    user = [(n, 1, n, f"c{n}", now - 50 * 60_000 + n) for n in range(120)] + [(500, 1, 500, "new", now)]
    got = {r.seq: r for r in rd.admit(spark.createDataFrame(user, schema)).collect()}
    assert got[500].status == "refused-user" and got[500].retry_after_ms == 10 * 60_000
    got = {r.seq: r.status for r in rd.admit(spark.createDataFrame(user[1:], schema)).collect()}
    assert got[500] == "admitted"
    block = [(n, n, n, "c", now - 20 * 60_000 + n) for n in range(30)] + [(500, 500, 1, "c", now)]
    got = {r.seq: r for r in rd.admit(spark.createDataFrame(block, schema)).collect()}
    assert got[500].status == "refused-block" and got[500].retry_after_ms == 40 * 60_000
    assert {r.seq: r.status for r in rd.admit(spark.createDataFrame(block[1:], schema)).collect()}[500] == "admitted"
    assert rd.admit(spark.createDataFrame([], schema)).count() == 0
    assert hour == rd.HOUR_MS


def test_search_budget(spark):
    rnd = random.Random(2)
    rows = sorted({(n, rnd.randrange(0, 3 * 86_400_000) // 1000 * 1000 if n % 2 else 86_400_000 - 5000 + n * 37) for n in range(400)})
    limit, held, want = rd.Limit(3, 60_000), [], {}
    for seq, ms in sorted(rows, key=lambda r: (r[1], r[0])):
        ok = sum(t > ms - limit.window_ms for t in held) < limit.count
        want[seq] = "admitted" if ok else "refused"
        held += [ms] * ok
    assert {r.seq: r.status for r in rd.search_budget(spark.createDataFrame(rows, "seq long, saved_ms long"), limit).collect()} == want


def test_venue_hours(spark):
    rows = [("v", 15, 55.0), ("v", 10, 48.0), ("v", 20, 48.0), ("w", 9, 60.0), ("w", 9, 80.0)]
    got = {r.venue_id: r for r in rd.venue_levels(rd.venue_hours(spark.createDataFrame(rows, "venue_id string, hour int, laeq double"))).collect()}
    assert (got["v"].quietest_hour, got["v"].quietest_laeq) == (10, pytest.approx(48))
    assert got["w"].hours[9] == pytest.approx(77.03, abs=0.01) and sum(h is None for h in got["w"].hours) == 23 and got["w"]["count"] == 2


def test_hours_as_text(spark):
    df = spark.createDataFrame([(h,) for h in (0, 9, 12, 18, 23)], "h int")
    assert [r[0] for r in df.select(ve.format_hour("h")).collect()] == ["12 am", "9 am", "12 pm", "6 pm", "11 pm"]


def test_search_response(spark):
    lat, lng = 37.7763, -122.4232
    cell = f"{hexgrid.cell_of(np.array([lat]), np.array([lng]), 10)[0]:x}"
    e = [
        '{"type":"node","id":2,"lat":37.7772,"lon":-122.4232,"tags":{"amenity":"cafe","name":"Far"}}', '{"type":"way","id":3,"center":{"lat":37.7763,"lon":-122.4233},"tags":{"amenity":"library","name":"  Lib "}}',
        '{"type":"node","id":4,"lat":37.7766,"lon":-122.4232,"tags":{"office":"coworking","name":"Work"}}', '{"type":"node","id":5,"lat":37.7763,"lon":-122.4232,"tags":{"amenity":"cafe"}}',
        '{"type":"node","id":6,"lat":37.7763,"lon":-122.4232,"tags":{"amenity":"bar","name":"Bar"}}', '{"type":"node","id":7,"lat":37.8,"lon":-122.27,"tags":{"amenity":"cafe","name":"Oakland"}}',
    ]
    raw = spark.createDataFrame([(cell, '{"elements":[' + ",".join(e) + "]}")], "cell string, raw string")
    v = ve.parse_search(raw)
    block = spark.createDataFrame([(cell,)], "cell string").withColumn("c", ve.cell_center("cell")).select("cell", "c.lat", "c.lng")
    got = ve.nearby(block, v.select("osm_id", "lat", "lng")).orderBy("rank").collect()
    assert [r.osm_id for r in got] == ["way/3", "node/4", "node/2"]
    assert {r.osm_id: (r.name, r.kind) for r in v.collect()}["way/3"] == ("Lib", "library")
    with pytest.raises(Exception, match="no elements"):
        ve.parse_search(spark.createDataFrame([(cell, "{}")], "cell string, raw string")).collect()


def test_areas(spark):
    parent = 0x89283082877FFFF
    base = (parent & ~(15 << 52)) | (10 << 52)
    kids = [f"{(base & ~(7 << 15)) | (d << 15):x}" for d in range(7)]
    schema = "cell string, laeq double"
    one = {r.res: r.laeq for r in sn.area_levels(spark.createDataFrame([(kids[0], 80.0)], schema)).collect()}
    assert one[9] == pytest.approx(80 - 10 * math.log10(7)) and 5 not in one
    full = {r.res: r for r in sn.area_levels(spark.createDataFrame([(k, 80.0) for k in kids], schema)).collect()}
    assert full[9].laeq == pytest.approx(80) and full[9].cell == f"{parent:x}"


def test_cards(spark):
    m = spark.createDataFrame([("a", 60.0, 2)], "cell string, laeq double, count long")
    s = spark.createDataFrame([("a", "not-covered", None), ("b", "not-covered", None), ("c", "below-floor", None)], "cell string, kind string, laeq24h double")
    assert sorted((r.cell, r.kind) for r in sn.cell_cards(m, s).collect()) == [("a", "not-covered"), ("c", "below-floor")]


def test_features(spark):
    f = sn.noise_features(spark.createDataFrame([(CELL, 61.26)], "cell string, laeq double"), F.lit(10)).first().value
    assert '"laeq":61.3' in f and '"minzoom":12,"maxzoom":12' in f and f.count("[-122.") == 7
    with pytest.raises(Exception, match="no zoom"):
        sn.noise_features(spark.createDataFrame([(CELL, 61.26)], "cell string, laeq double"), F.lit(4)).collect()


def test_pixel_lines(spark):
    lines = ["-122.4196 37.7651 61.25", "  1 2 3 ", "1 2", "1 2 x", "1 2 3 4", "1 2 3.4e38", "", "1 2 NaN", None]
    got = [tuple(r) for r in tx.parse_pixels(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [(-122.4196, 37.7651, 61.25), (1.0, 2.0, 3.0)]


def test_ways(spark):
    lines = ["w7 Thighway=footway,name=A%20%B,name=C,bridge=yes Nn1x-122.418y37.78,n2xy,n3x-122.41600004y37.7801", "n1 x", "w8 T N"]
    got = {r.way_id: r for r in tx.parse_ways(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got[7].tags == {"highway": "footway", "name": "C", "bridge": "yes"}
    assert [tuple(n) for n in got[7].nodes] == [(1, -1224180000, 377800000), (2, None, None), (3, -1224160000, 377801000)]
    assert got[8].tags == {} and got[8].nodes == []
    unescaped = tx.parse_ways(spark.createDataFrame([("w1 Tname=A%20%B N",)], "value string")).first().tags
    assert unescaped == {"name": "A B"}


def test_walkable_and_level(spark):
    cases = [({"highway": "footway"}, True, 0), ({"highway": "motorway"}, False, 0), ({"highway": "path", "foot": "no"}, False, 0), ({"highway": "service", "access": "private"}, False, 0), ({"highway": "service", "access": "private", "foot": "yes"}, True, 0), ({"highway": "path", "bridge": "yes"}, True, 1), ({"highway": "path", "bridge": "yes", "layer": "0"}, True, 0), ({"highway": "path", "tunnel": "yes", "layer": "1.5"}, True, -1), ({}, False, 0)]
    df = spark.createDataFrame([(n, t) for n, (t, *_) in enumerate(cases)], "n int, tags map<string,string>")
    assert [tuple(r)[1:] for r in df.select("n", wg.walkable(), wg.way_level()).orderBy("n").collect()] == [c[1:] for c in cases]


def test_cut_points():
    start, end = np.array([[-1224180000, 377800000], [-1224180000, 377800000]]), np.array([[-1224160000, 377801000], [-1224179000, 377800030]])
    who, a, b, cell = wg.cut_points(start, end)
    assert [(w, *x, *y, f"{c:x}") for w, x, y, c in zip(who, a.tolist(), b.tolist(), cell, strict=True)] == [
        (0, -1224180000, 377800000, -1224178882, 377800056, "8a2830828747fff"), (0, -1224178882, 377800056, -1224163218, 377800839, "8a2830828757fff"),
        (0, -1224163218, 377800839, -1224160000, 377801000, "8a2830828627fff"), (1, -1224180000, 377800000, -1224179000, 377800030, "8a2830828747fff"),
    ]
    again = wg.cut_points(a, b)
    assert (again[1] == a).all() and (again[2] == b).all()
    assert len(wg.cut_points(np.zeros((0, 2)), np.zeros((0, 2)))[0]) == 0


def test_levels_are_separated(spark):
    ref = "way_id long, pos int, node_id long, lng_e7 int, lat_e7 int, level int, flags int"
    rows = [(1, 0, 5, 10, 20, 0, 0), (2, 0, 3, 10, 20, 1, 0), (3, 0, 9, 10, 20, 1, 0), (4, 0, 7, 1, 1, 0, 0), (5, 0, 8, 1, 1, 0, 0), (6, 1, 9, 10, 20, 1, 0)]
    got = {(r.way_id, r.node_id): r.lat_e7 for r in wg.separate_levels(spark.createDataFrame(rows, ref)).collect()}
    assert got == {(2, 3): 20, (1, 5): 21, (3, 9): 22, (6, 9): 22, (4, 7): 1, (5, 8): 1}


def test_tile_layout():
    nodes, ends = np.array([[0, 0], [10, 10], [20, 20]]), np.array([[0, 1], [1, 2]])
    cells = [0x8A2830828747FFF, 0x8A2830828757FFF, 0x8A2830828627FFF]
    data = wg.encode_tile(nodes, ends, np.array([0, 2]), np.array([0, 1]), cells, [623, 0, 65535])
    assert len(data) == 94 and data[:4] == b"SMW2"
    t = wg.decode_tile(data)
    assert t["nodes"].tolist() == nodes.tolist() and t["ends"].tolist() == ends.tolist() and t["cells"].tolist() == cells and t["codes"].tolist() == [623, 0, 65535]
    at = 16 + 24
    for bad in (b"SMW1" + data[4:], data[:-1], data[:at] + b"\x03" + data[at + 1 :], data[: at + 16] + b"\x03" + data[at + 17 :]):
        with pytest.raises(ValueError):
            wg.decode_tile(bad)


PIECE = "cell string, tile_x int, tile_y int, from_lng int, from_lat int, to_lng int, to_lat int, flags int"


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    rows = [("c", a // 10, 0, a, 0, b, 0, 0) for a, b in edges if a != b]
    above = list(range(60))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for r in rows:
        above[max(top(r[3]), top(r[5]))] = min(top(r[3]), top(r[5]))
    got = {r.lng_e7: r.component for r in wg.node_components(spark.createDataFrame(rows, PIECE)).collect()}
    groups = defaultdict(set)
    for n, c in got.items():
        groups[c].add(n)
    want = defaultdict(set)
    for n in got:
        want[top(n)].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# Street graphs of the routes: meters from (-122.42, 37.77), edges of at most 100 m, one cell a street.
LNG, LAT = -122.42, 37.77
MX, MY = 1e7 / (111195.0798 * math.cos(math.radians(LAT))), 1e7 / 111195.0798


def streets(spark, lines):
    """lines: (name, kind, level, flags, [(x, y), ...])"""
    rows = []
    for name, kind, level, flags, points in lines:
        for (ax, ay), (bx, by) in zip(points, points[1:]):
            n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / 100))
            at = [(round(LNG * 1e7 + (ax + (bx - ax) * k / n) * MX), round(LAT * 1e7 + (ay + (by - ay) * k / n) * MY)) for k in range(n + 1)]
            rows += [(*routes._tile(a[0] / 1e7, a[1] / 1e7), len(rows) + k, *a, *b, flags, name, kind, level) for k, (a, b) in enumerate(zip(at, at[1:]))]
    return spark.createDataFrame(rows, "tile_x int, tile_y int, edge_no long, from_lng int, from_lat int, to_lng int, to_lat int, flags int, cell string, kind string, level double")


def plan(spark, edges, a, b):
    p = lambda q: (LNG + q[0] * MX / 1e7, LAT + q[1] * MY / 1e7)
    trips = spark.createDataFrame([("t", *p(a), *p(b))], "trip_id string, from_lng double, from_lat double, to_lng double, to_lat double")
    return routes.plan_walks(trips, edges).persist()


def stats(walks):
    pieces = routes.merged(walks.where("outcome = 'planned'"), ["trip_id", "weight"])
    return {r.weight: r for r in routes.route_stats(pieces, ["trip_id", "weight"]).collect()}


def ladder(main=("modeled", 70.0), side=("modeled", 50.0)):
    return [("main", *main, 0, [(0, 0), (1000, 0)]), ("west", *side, 0, [(0, 0), (0, 100)]), ("side", *side, 0, [(0, 100), (1000, 100)]), ("east", *side, 0, [(1000, 100), (1000, 0)])]


def test_ladder(spark):
    w = plan(spark, streets(spark, ladder()), (0, 0), (1000, 0))
    s = stats(w)
    assert (s[0].meters, s[0].laeq, s[0].loud_meters) == (pytest.approx(1000, abs=0.5), pytest.approx(70), pytest.approx(1000, abs=0.5))
    c = routes.choices(w).collect()
    assert [(r.preset, round(r.meters), r.quieter_db, round(r.extra_meters), round(r.loud_meters_avoided), r.noticeable) for r in c] == [("quieter", 1200, 20, 200, 1000, True)]


def test_measured_wins(spark):
    w = plan(spark, streets(spark, ladder(main=("measured", 48.0))), (0, 0), (1000, 0))
    assert routes.choices(w).count() == 0 and stats(w)[0].measured_blocks == 1


def test_floor_and_gaps(spark):
    half = [("a", "below-floor", None, 0, [(0, 0), (500, 0)]), ("b", "modeled", 55.0, 0, [(500, 0), (1000, 0)])]
    assert stats(plan(spark, streets(spark, half), (0, 0), (1000, 0)))[0].laeq == pytest.approx(52.40, abs=0.01)
    half[0] = ("a", "not-covered", None, 0, [(0, 0), (500, 0)])
    assert stats(plan(spark, streets(spark, half), (0, 0), (1000, 0)))[0].laeq == pytest.approx(55)
    none = [("a", "not-covered", None, 0, [(0, 0), (1000, 0)])]
    w = plan(spark, streets(spark, none), (0, 0), (1000, 0))
    assert stats(w)[0].laeq is None and routes.choices(w).count() == 0


def test_partial_edges_and_steps(spark):
    assert stats(plan(spark, streets(spark, [("a", "modeled", 60.0, 0, [(0, 0), (300, 0)])]), (110, 0), (190, 0))) == {}  # too close
    long = [("a", "modeled", 60.0, 0, [(0, 0), (800, 0)])]
    assert stats(plan(spark, streets(spark, long), (50, 0), (750, 0)))[0].meters == pytest.approx(700, abs=0.5)
    steps = [("steps", "modeled", 60.0, 1, [(0, 0), (300, 0)]), ("road", "modeled", 60.0, 0, [(0, 0), (0, 100), (300, 100), (300, 0)])]
    assert stats(plan(spark, streets(spark, steps), (0, 0), (300, 0)))[0].meters == pytest.approx(500, abs=0.5)


def test_outcomes(spark):
    e = streets(spark, ladder())
    out = lambda a, b, edges=e: {r.outcome for r in plan(spark, edges, a, b).collect()}
    assert out((0, 0), (6000, 0)) == {"too-far"} and out((0, 0), (60, 0)) == {"too-close"}
    assert out((0, -200), (1000, 0)) == {"off-path-from"} and out((0, 0), (1000, -200)) == {"off-path-to"}
    assert out((0, 0), (1000, 0), e.where("1 = 0")) == {"no-walking-data"}
    apart = streets(spark, [("a", "modeled", 60.0, 0, [(0, 0), (300, 0)]), ("b", "modeled", 60.0, 0, [(300.02, 0), (600, 0)])])
    assert out((0, 0), (600, 0), apart) == {"no-path"}


def test_search_is_cheapest():
    """Against Dijkstra's algorithm on random grids, all weights at once; places on one edge and at corners too."""
    rnd = random.Random(8)
    for size in (3, 8):
        rows = []
        for i in range(size):
            for j in range(size):
                for di, dj in ((1, 0), (0, 1)):
                    if i + di < size and j + dj < size and rnd.random() < 0.85:
                        p = lambda i, j: (round(LNG * 1e7 + i * 90 * MX), round(LAT * 1e7 + j * 90 * MY))
                        rows.append((0, 0, *p(i, j), *p(i + di, j + dj), rnd.choice([45.0, 60.0, 75.0, math.nan]), rnd.choice([0, 0, 1])))
        edges = routes.Streets(pd.DataFrame(rows, columns=["tile_x", "tile_y", "from_lng", "from_lat", "to_lng", "to_lat", "db", "flags"]))
        g = routes.Corridor(edges, np.arange(len(rows)), (LNG - 0.1, LAT - 0.1, LNG + 0.1, LAT + 0.1))
        weights = [0.0, 0.5, 3.0]
        for trial in range(40):
            (a, sa), (b, sb) = ((rnd.randrange(len(rows)), rnd.choice([0.0, 1.0, rnd.random(), rnd.random()])) for _ in range(2))
            if trial % 8 == 0:
                b = a
            walks = g.walks((a, sa), (b, sb), weights)
            for k, cost in enumerate(g.costs(weights)):
                best = {n: math.inf for n in range(len(g.xy))}
                best[g.ends[a, 0]], best[g.ends[a, 1]] = cost[a] * sa, cost[a] * (1 - sa)
                for _ in range(len(best)):
                    for e, (u, v) in enumerate(g.ends):
                        best[u], best[v] = min(best[u], best[v] + cost[e]), min(best[v], best[u] + cost[e])
                want = min(best[g.ends[b, 0]] + cost[b] * sb, best[g.ends[b, 1]] + cost[b] * (1 - sb), abs(sa - sb) * cost[a] if a == b else math.inf)
                if walks is None:  # no way, or nothing to walk
                    assert want == math.inf or want < 1e-9
                    continue
                assert sum(abs(y - x) * cost[e] for e, x, y in walks[k]) == pytest.approx(want)
                # It hangs together: each stretch begins where the one before ended.
                at = lambda e, x: g.xy[g.ends[e, 0]] + x * (g.xy[g.ends[e, 1]] - g.xy[g.ends[e, 0]])
                ways = [(a, sa, sa), *walks[k], (b, sb, sb)]
                assert all(np.allclose(at(e, y), at(f, x), atol=1e-6) for (e, _, y), (f, x, _) in zip(ways, ways[1:]))


def grid(rnd, size, twice=0.3):
    """Streets of a grid with gaps, some of them double, with levels and steps by chance, in two tiles."""
    rows = []
    p = lambda i, j: (round(LNG * 1e7 + i * 90 * MX), round(LAT * 1e7 + j * 90 * MY))
    for i in range(size):
        for j in range(size):
            for di, dj in ((1, 0), (0, 1)):
                while i + di < size and j + dj < size and rnd.random() < 0.9:
                    ends = [p(i, j), p(i + di, j + dj)][:: rnd.choice([1, -1])]
                    rows.append((*routes._tile(ends[0][0] / 1e7, ends[0][1] / 1e7), len(rows), *ends[0], *ends[1], rnd.choice([45.0, 45.0, 60.0, 75.0, math.nan]), rnd.choice([0, 0, 1]), f"c{i // 3}-{j // 3}", "modeled"))
                    if rnd.random() > twice:
                        break
    e = pd.DataFrame(rows, columns=["tile_x", "tile_y", "edge_no", "from_lng", "from_lat", "to_lng", "to_lat", "db", "flags", "cell", "kind"])
    return e.sort_values(["tile_x", "tile_y", "edge_no"]).reset_index(drop=True)


def test_trips_that_are_searched_together(monkeypatch):
    """Every walk of a bundle is that of its trip alone, ties too, with places on streets, at corners and off all paths."""
    rnd, weights, outcomes = random.Random(4), [0.0, 0.5, 3.0], set()
    monkeypatch.setattr(routes, "BUNDLE", 7)
    for size in (2, 5, 12):
        e = grid(rnd, size)
        streets = routes.Streets(e)
        at = lambda: (rnd.choice([rnd.randrange(size), rnd.uniform(-1, size + 2)]), rnd.choice([rnd.randrange(size), rnd.uniform(-1, size)]))  # noqa: E731,B023
        point = lambda a: (LNG + a[0] * 90 * MX / 1e7, LAT + a[1] * 90 * MY / 1e7)
        trips = []
        for k in range(60):
            a, b = point(at()), point(at())
            far = rnd.choice([0.0005, 0.004])
            box = {"west": min(a[0], b[0]) - far, "south": min(a[1], b[1]) - far, "east": max(a[0], b[0]) + far, "north": max(a[1], b[1]) + far}
            trips.append((str(k), *a, *b, box))
        away = {"west": LNG + 1, "south": LAT + 1, "east": LNG + 1.001, "north": LAT + 1.001}
        trips.append(("away", LNG + 1, LAT + 1, LNG + 1, LAT + 1, away))
        t = pd.DataFrame(trips, columns=["trip_id", "from_lng", "from_lat", "to_lng", "to_lat", "box"])
        want = {}
        for r in t.itertuples(index=False):
            box = tuple(r.box[k] for k in ("west", "south", "east", "north"))
            rows = streets.rows_in(box)
            if rows is None:
                want[r.trip_id] = "no-walking-data"
                continue
            g = routes.Corridor(streets, rows, box)
            places = g.snap(r.from_lng, r.from_lat), g.snap(r.to_lng, r.to_lat)
            walks = None if None in places else g.walks(*places, weights)
            want[r.trip_id] = [[(int(rows[k]), x, y, abs(y - x) * g.meters[k]) for k, x, y in w] for w in walks] if walks else "off-path-from" if places[0] is None else "off-path-to" if places[1] is None else "no-path"
        got = {}
        for one, found in routes.searched(t, e, weights):
            ids = one.trip_id.tolist()
            got |= {k: [[] for _ in weights] if o == "planned" else o for k, o in zip(ids, one.outcome)}
            for k, w, n, *stretch in zip(*(found[c].tolist() for c in ("trip", "weight", "stretch_no", "row", "start", "end", "meters"))):
                assert n == len(got[ids[k]][w])
                got[ids[k]][w].append(tuple(stretch))
        assert got == want
        outcomes |= {x if isinstance(x, str) else "planned" for x in want.values()}
    assert outcomes == {"planned", "no-path", "off-path-from", "off-path-to", "no-walking-data"}


def test_routes_without_their_stretches(spark):
    """plan_routes gives what comes of plan_walks' stretches, and medians count a value as often as it is there."""
    rnd = random.Random(6)
    edges = spark.createDataFrame([tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in grid(rnd, 9).itertuples(index=False)], "tile_x int, tile_y int, edge_no long, from_lng int, from_lat int, to_lng int, to_lat int, level double, flags int, cell string, kind string")
    point = lambda: (LNG + rnd.randrange(9) * 90 * MX / 1e7, LAT + rnd.uniform(0, 9) * 90 * MY / 1e7)
    trips = spark.createDataFrame([(str(k), *point(), *point()) for k in range(40)] + [("far", LNG, LAT, LNG + 1, LAT)], "trip_id string, from_lng double, from_lat double, to_lng double, to_lat double")
    walks, got = routes.plan_walks(trips, edges).persist(), routes.plan_routes(trips, edges).persist()
    outcome = lambda d: sorted({(r.trip_id, r.outcome) for r in d.collect()})
    assert outcome(walks) == outcome(got)
    s = {(r.trip_id, r.weight): r for r in routes.route_stats(routes.merged(walks.where("outcome = 'planned'"), ["trip_id", "weight"]), ["trip_id", "weight"]).collect()}
    for r in got.where("outcome = 'planned'").collect():
        w = s.pop((r.trip_id, r.weight))
        assert (r.meters, r.laeq, r.loud_meters) == (pytest.approx(w.meters), w.laeq and pytest.approx(w.laeq), pytest.approx(w.loud_meters))
    assert not s
    pick = lambda d: sorted((r.trip_id, r.preset, r.weight, round(r.meters, 6), round(r.quieter, 6)) for r in d.collect())
    chosen = routes.choices(walks)
    assert pick(chosen) == pick(routes.choices_of(got.where("outcome = 'planned'"))) and chosen.count()
    many = walks.where("outcome = 'planned'").select("trip_id").distinct().withColumn("times", F.col("trip_id").cast("long") % 3 + 1)
    copies = lambda d: d.join(many, "trip_id").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("trip_id", F.concat_ws("/", "trip_id", "k")).drop("k", "times")
    shown = lambda d: sorted(tuple(r) for r in d.select("preset", "trips", "median_db", "median_detour", "max_detour", "n1", "n3").collect())
    assert shown(routes.evaluate(many, chosen)) == shown(routes.evaluate(copies(many.select("trip_id")), copies(chosen)))


def test_a_weighting():
    """Published values of the curve, and the filter as one difference equation."""
    rate = 48_000
    t = np.arange(rate) / rate
    level = lambda hz: meter.frames_of(np.sin(2 * np.pi * hz * t), rate)[-1]
    assert level(1000) == pytest.approx(20 * math.log10(1 / math.sqrt(2)), abs=0.05)
    assert level(100) - level(1000) == pytest.approx(-19.1, abs=0.3)
    assert meter.frame_length(44_100) == 5513 and meter.frame_length(48_000) == 6000
    assert meter.frames_of(np.zeros(6001), rate).tolist() == [-180.0]
    for rate in (800, 8000, 48_000):
        x = np.random.default_rng(1).normal(0.3, 0.1, 1500)
        y = difference_equation(x, rate)
        f = meter.a_weighting(rate)
        assert np.allclose(f.run(x)[0], y, atol=1e-9)
        for cut in (0, 1, 255, 256, 700):
            first, state = f.run(x[:cut])
            assert np.allclose(np.concatenate([first, f.run(x[cut:], state)[0]]), y, atol=1e-9)


def difference_equation(x, rate):
    zeros, poles, gain = meter.a_chain(rate)
    b, a, y = np.poly(zeros) * gain, np.poly(poles), [0.0] * 6
    x = [0.0] * 6 + list(x)
    for k in range(6, len(x)):
        y.append(sum(c * x[k - i] for i, c in enumerate(b)) - sum(c * y[k - i] for i, c in enumerate(a) if i))
    return np.array(y[6:])


@pytest.mark.parametrize("run", [512, 2])
def test_level_frames_across_chunks(spark, monkeypatch, run):
    """Sessions of chunks of any length, empty ones too, in runs of any length."""
    monkeypatch.setattr(meter, "RUN", run)
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for name, rate, cuts in (("s", 8000, [0, 700, 700, 701, 2500, 6100]), ("t", 800, [0, 999, 1000]), ("u", 8000, [0, 500]), ("v", 4000, [*range(0, 4001, 250)])):
        pcm = rng.normal(0.2, 0.1, cuts[-1]).astype("float32")
        rows += [(name, 3 * k, rate, pcm[a:b].tolist(), "x", 1.0) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        n, y = meter.frame_length(rate), difference_equation(pcm.astype(float), rate)
        want |= {(name, k): 20 * math.log10(math.sqrt((y[k * n : (k + 1) * n] ** 2).mean())) for k in range(len(y) // n)}
    rnd = random.Random(3)
    rnd.shuffle(rows)
    rows += [("n", 0, 8000, None, "x", 1.0), ("n", 1, 8000, [], "x", 1.0), (None, 0, 8000, [1.0] * 1000, "x", 1.0), ("z", 0, None, [1.0] * 1000, "x", 1.0), ("h", 0, 800, [None] * 100, "x", 1.0)]
    samples = spark.createDataFrame(rows, "session_id string, chunk_no int, sample_rate int, pcm array<float>, state string, n double")
    got = {(r.session_id, r.frame_no): r.dbfs for r in meter.level_frames(samples).collect()}
    assert got.pop(("h", 0)) == -180
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert meter.level_frames(samples.limit(0)).count() == 0


def test_long_session(spark):
    """Two million samples of one session in 16 chunks: within 1e-6 dB of one pass over all."""
    chunks = spark.range(16).select(F.lit("s").alias("session_id"), F.col("id").alias("chunk_no"), F.lit(48_000).alias("sample_rate"), F.transform(F.sequence(F.col("id") * 125_000, F.col("id") * 125_000 + 124_999), lambda i: F.sin(i * i / 1e7).cast("float")).alias("pcm"))
    pcm = np.concatenate([r.pcm for r in chunks.orderBy("chunk_no").collect()])
    got = [r.dbfs for r in meter.level_frames(chunks.repartition(8)).orderBy("frame_no").collect()]
    assert len(got) == 2_000_000 // 6000 and np.abs(np.array(got) - meter.frames_of(pcm, 48_000)).max() < 1e-6


@pytest.mark.parametrize("kind", ["long", "double"])
def test_ranks(spark, monkeypatch, kind):
    """Against sorting, with ties, nulls, a wide range and few parts a round."""
    monkeypatch.setattr(ranks, "PARTS", 4)
    rnd = random.Random(6)
    values = [rnd.choice([rnd.randrange(50), rnd.randrange(10**15), -7, None]) for _ in range(300)] + [42] * 200
    df = spark.createDataFrame([(v if v is None or kind == "long" else v / 8,) for v in values], f"v {kind}").repartition(3)
    held = sorted(r.v for r in df.collect() if r.v is not None)
    asked = [0, 1, len(held) // 3, len(held) // 2, len(held) - 1, len(held), -1]
    assert ranks.elements_at(df, "v", asked) == {k: held[k] for k in asked if 0 <= k < len(held)}
    assert ranks.median(df, "v") == np.median(held) and ranks.median(df.limit(0), "v") is None
    row = wg.size_distribution(df.where("v >= 0").withColumnRenamed("v", "bytes")).first()
    own = [v for v in held if v >= 0]
    assert (row.n, row.median, row.p95, row.largest) == (len(own), own[len(own) // 2], own[math.floor(0.95 * len(own))], own[-1])
    assert wg.size_distribution(df.limit(0).withColumnRenamed("v", "bytes")).first().n == 0


def test_levels_without_a_code(spark):
    df = spark.createDataFrame([("modeled", 45.04), ("below-floor", None), ("not-covered", None), ("measured", 0.1)], "kind string, level double")
    assert [r[0] for r in df.select(sn.encode_level("kind", "level")).collect()] == [450, 0, 65535, 1]
    for level in (0.0, 0.04, -3.0, 6553.5, None):
        with pytest.raises(Exception, match="no code for a level"):
            spark.createDataFrame([("modeled", level)], "kind string, level double").select(sn.encode_level("kind", "level").alias("c")).collect()


def test_sorted_outputs(spark, tmp_path):
    """Blocks are sorted over all files, regions and windows in their order."""
    rnd = random.Random(2)
    cells = [f"8a2830{rnd.randrange(16**6):06x}fff" for _ in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tx.write_blocks(spark.createDataFrame([(c, 50.0) for c in cells], "cell string, laeq double").repartition(6), str(tmp_path / "b"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "b").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert len(files) > 1 and [x.split("\t")[0] for x in lines] == sorted(cells)
    bad = spark.createDataFrame([("8a2830828757fff\t?",)], "value string")
    with pytest.raises(Exception, match="bad block 8a2830828757fff"):
        tx.good_blocks(bad).collect()
    assert [tuple(r) for r in tx.good_blocks(spark.createDataFrame([("8a2830828757fff\t51.5",)], "value string")).collect()] == [("8a2830828757fff", 51.5)]
    found = hexgrid.regions_in(-123.0, 37.0, -121.0, 38.5)
    assert found == sorted(found) and len(found) > 20


def test_coordinates_of_features(spark):
    """Rings of coverage as they are in the text, and hexagons' corners at the distance of their edge from the center."""
    outer, hole, part = [[0.0, 0.0], [4.0, 0.5], [4.0, 4.0], [0.0, 0.0]], [[1.0, 0.5], [2.0, 0.6], [2.0, 1.5], [1.0, 0.5]], [[9.0, 9.0], [9.5, 9.0], [9.5, 9.25], [9.0, 9.0]]
    lines = [json.dumps({"properties": {"STATEFP": s}, "geometry": {"type": t, "coordinates": c}}) for s, t, c in (("06", "Polygon", [outer, hole]), ("12", "MultiPolygon", [[outer, hole], [part]]), ("60", "Polygon", [outer]), ("x", "Polygon", [outer]))]
    got = defaultdict(list)
    for r in tx.parse_coverage(spark.createDataFrame([(x,) for x in lines], "value string")).collect():
        got[r.poly_id].append(r.ring)
    assert got == {"06": [outer, hole], "12": [outer, hole, part]}
    cell = "8a2830828757fff"
    f = json.loads(sn.noise_features(spark.createDataFrame([(cell, 61.26)], "cell string, laeq double"), F.lit(10)).first().value)
    ring = f["geometry"]["coordinates"][0]
    y, x = (c[0] for c in hexgrid.cell_center(np.array([int(cell, 16)])))
    meters = [math.hypot((a - x) * math.cos(math.radians(y)), b - y) * 111_195 for a, b in ring]
    assert ring[0] == ring[-1] and len(ring) == 7 and f["properties"] == {"cell": cell, "laeq": 61.3} and all(60 < m < 90 for m in meters)
    assert all(round(c, 6) == c for p in ring for c in p)
    turn = sum((a[0] - x) * (b[1] - y) - (b[0] - x) * (a[1] - y) for a, b in zip(ring, ring[1:]))
    assert turn > 0  # counterclockwise
    # Each corner's neighbour beyond it: the same point is a corner of three cells.
    inner = [[a + (x - a) * 0.02, b + (y - b) * 0.02] for a, b in ring[:-1]]
    assert {f"{c:015x}" for c in hexgrid.cell_of(*np.array(inner).T[::-1], 10)} == {cell}


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    schema = "seq long, user_id long, client_id long, cell string, saved_ms long, laeq double"
    rows = sorted((rnd.randrange(0, 60_000), n, rnd.randrange(4), rnd.randrange(30), f"c{rnd.randrange(5)}") for n in range(200))
    df = spark.createDataFrame([(n, u, c, cell, ms, 50.0 + n % 30) for ms, n, u, c, cell in rows], schema)
    for k in range(3):  # three files, read one by one
        df.where(f"saved_ms >= {k * 20_000} AND saved_ms < {(k + 1) * 20_000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    user, block = rd.Limit(4, 10_000), rd.Limit(3, 5_000)
    pick = lambda d: sorted((r.seq, r.status) for r in d.collect())
    assert pick(jobs.admit_stream(stream, user, block)) == pick(rd.admit(df, user, block))
    got = {r.cell: (r["count"], round(r.energy)) for r in jobs.rollup(stream, ["cell"], "cell string").collect()}
    assert got == {r.cell: (r["count"], round(r.energy)) for r in rd.cell_rollup(df).collect()}


def test_stream_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    """A batch that dies between its two writes runs again, in a new job over the same folder, and later input is added."""
    schema = "seq long, user_id long, client_id long, cell string, saved_ms long, laeq double"
    rnd = random.Random(6)
    rows = [(n, rnd.randrange(4), rnd.randrange(30), f"c{rnd.randrange(3)}", 500 * n, 50.0 + n % 30) for n in range(120)]
    df = spark.createDataFrame(rows, schema)
    add = lambda k: df.where(f"seq >= {k * 40} AND seq < {k * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(0), add(1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    user, block = rd.Limit(4, 10_000), rd.Limit(3, 5_000)
    publish, fails = store.Store._publish, ["admission", "rollup"]

    def dying(self, batch, now):
        name = self.folder.rsplit("/", 1)[1]
        if batch == 1 and name in fails:
            fails.remove(name)
            if name == "rollup":
                publish(self, batch, now)  # all is there, but the stream doesn't know
            raise RuntimeError("killed")
        publish(self, batch, now)

    monkeypatch.setattr(store.Store, "_publish", dying)
    at = [str(tmp_path / "admission"), str(tmp_path / "rollup")]
    for run in (lambda: jobs.admit_stream(stream, user, block, at[0]), lambda: jobs.rollup(stream, ["cell"], "cell string", folder=at[1])):
        with pytest.raises(Exception, match="killed"):
            run()
    assert not fails
    jobs.admit_stream(stream, user, block, at[0]), jobs.rollup(stream, ["cell"], "cell string", folder=at[1])
    add(2)
    pick = lambda d: sorted((r.seq, r.status, r.retry_after_ms) for r in d.collect())
    assert pick(jobs.admit_stream(stream, user, block, at[0])) == pick(rd.admit(df, user, block))
    got = {r.cell: (r["count"], round(r.energy)) for r in jobs.rollup(stream, ["cell"], "cell string", folder=at[1]).collect()}
    assert got == {r.cell: (r["count"], round(r.energy)) for r in rd.cell_rollup(df).collect()}


def test_busy_block(spark):
    """A third of all rows in one block: arrivals and visits as counted one by one, over several days."""
    rnd = random.Random(12)
    rows = [(n, rnd.randrange(9), "hot" if rnd.random() < 0.4 else f"c{rnd.randrange(6)}", rnd.randrange(5 * 86_400_000) // 60_000 * 60_000, f"node/{rnd.randrange(4)}", 9) for n in range(400)]
    df = spark.createDataFrame(rows, "seq long, user_id long, cell string, saved_ms long, osm_id string, hour int")
    got = {r.seq: r.n for r in rd.with_arrivals(df, "n", "cell", 3_600_000).collect()}
    assert got == {q: sum(c2 == c and t - 3_600_000 < t2 and (t2, q2) < (t, q) for q2, _, c2, t2, *_ in rows) for q, _, c, t, *_ in rows}
    found = [(c, t + 7, [f"node/{rnd.randrange(4)}"]) for _, _, c, t, *_ in rnd.sample(rows, 25)]
    found = list({(c, t): (c, t, v) for c, t, v in found}.values())
    searches = spark.createDataFrame([(c, t, [(x,) for x in v]) for c, t, v in found], "cell string, fetched_ms long, venues array<struct<osm_id string>>")
    got = {r.seq: r.venue_id for r in rd.attach_visits(df, searches).collect()}
    for q, _, c, t, v, _ in rows:
        last = max(((t2, v2) for c2, t2, v2 in found if c2 == c and t2 <= t), default=(0, []))
        assert got[q] == (v if v in last[1] else None)


def test_unescaped(spark):
    import re

    rnd = random.Random(3)
    texts = ["A%20%B", "100% sure", "%zz%20%", "%41%%42%", "%", "%%", "%1f600%", "a%41%b%", "", "%41", "no"] + ["".join(rnd.choice(["%", "%", "4", "1", "f", "z"]) for _ in range(rnd.randrange(9))) for _ in range(300)]
    texts = [t for t in texts if not any(int(x, 16) == 0 or int(x, 16) > 0x10FFFF or 0xD800 <= int(x, 16) < 0xE000 for x in re.findall(r"[0-9a-f]+", t))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.unescaped(F.col("t")).alias("u")).collect()
    for r in got:
        assert r.u == re.sub(r"%([0-9a-f]+)%", lambda m: chr(int(m[1], 16)), r.t), r.t


def test_removal_leaves_nothing(spark):
    rows = spark.createDataFrame([("a", 60.0, 1), ("a", 80.0, 1), ("a", 80.0, -1), ("a", 60.0, -1), ("b", 50.0, 1)], "cell string, laeq double, sign int")
    empty = spark.createDataFrame([], "cell string, energy double, count long")
    assert [r.cell for r in jobs.merged(empty, jobs.signed_rollup(rows, ["cell"], F.col("sign")), ["cell"]).collect()] == ["b"]


def test_equal_trips_share_their_regions(spark):
    """Each trip has its row, whether its ends are another's or not."""
    ends = [(-122.42, 37.7, -122.41, 37.72), (-122.2, 37.6, -122.19, 37.61)]
    trips = spark.createDataFrame([(f"t{k}", *ends[k % 2]) for k in range(7)], "trip_id string, from_lng double, from_lat double, to_lng double, to_lat double")
    got = {r.trip_id: r.regions for r in routes.trip_regions(trips).collect()}
    assert sorted(got) == [f"t{k}" for k in range(7)] and all(got[f"t{k}"] == got[f"t{k % 2}"] for k in range(7)) and got["t0"] and got["t1"]


def test_measured_sums_of_trips(spark):
    """What the measured cells of each trip's regions come to, without a row for each of them."""
    ends = [(-122.42, 37.7, -122.41, 37.72), (-122.35, 37.75, -122.31, 37.75), (10.0, 10.0, 10.01, 10.01)]
    trips = spark.createDataFrame([(f"t{k}", *ends[k % 3]) for k in range(9)], "trip_id string, from_lng double, from_lat double, to_lng double, to_lat double")
    measured = spark.range(400).select(ad.cell(F.col("id")).alias("cell"), F.lit(50.0).alias("laeq"), (F.col("id") % 5).alias("count"))
    want = {r.trip_id: (r.cells, r.readings) for r in routes.trip_measured(trips, measured).groupBy("trip_id").agg(F.count("*").alias("cells"), F.sum("count").alias("readings")).collect()}
    assert {r.trip_id: (r.cells, r.readings) for r in routes.trip_measured_sums(trips, measured).collect()} == want and want and "t2" not in want


def test_street_level_of_a_cell_with_several_centers(spark):
    """Inside if any center is, in whatever order they come."""
    shore = ad.shore(spark)
    for places in ([(37.73, -122.46), (37.0, -122.46)], [(37.0, -122.46), (37.73, -122.46)]):
        cells = spark.createDataFrame([("a", *p) for p in places] + [("b", 37.0, -122.0)], "cell string, lat double, lng double").coalesce(1)
        none = spark.createDataFrame([], "cell string, laeq double")
        assert {(r.cell, r.kind) for r in sn.street_level(cells, none, shore, located=True).collect()} == {("a", "below-floor"), ("b", "not-covered")}


def test_street_blocks_have_their_highest_level(spark, tmp_path):
    """Of a block with several levels, in whatever order they come."""
    from hushgrid.plans import queries

    for k, sizes in enumerate(([30, 40, 50], [50, 40, 30])):
        rows = [(7 + 16807 * n, size) for n, size in enumerate(sizes)]
        spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/{k}/part.parquet")
        assert [(r.kind, r.laeq24h) for r in queries.street(spark, f"{tmp_path}/{k}").distinct().collect()] == [("modeled", 95.0)]


def test_nearby_with_crowded_places(spark):
    """Many venues at one place, many blocks at one, and a block with several centers: the nearest eight of all pairs."""
    far = lambda lat, v: 2 * 6_371_008.8 * math.asin(math.sqrt(math.sin(math.radians(lat - v) / 2) ** 2))
    venue = [(f"node/{k:05}", 60.0 + k % 3 * 0.0006, 10.0) for k in range(20_000)]
    block = [(f"c{k % 9000}", 60.0 + k % 4 * 0.0005, 10.0) for k in range(20_000)]
    got = ve.nearby(spark.createDataFrame(block, "cell string, lat double, lng double"), spark.createDataFrame(venue, "osm_id string, lat double, lng double"), rings=None)
    found = defaultdict(list)
    for r in got.collect():
        found[r.cell].append((r["rank"], r.osm_id, round(r.meters, 3)))
    at = defaultdict(list)
    for osm, lat, _ in venue[:24]:  # of each place the first eight
        at[lat].append(osm)
    assert len(found) == 9000
    for cell in ("c0", "c1", "c2500", "c8999"):
        pairs = [((v - lat) ** 2, osm, far(lat, v)) for c, lat, _ in block if c == cell for v, ids in at.items() for osm in ids]
        want = sorted((d2, osm, m) for d2, osm, m in pairs if m <= 150)[:8]
        assert sorted(found[cell]) == [(k + 1, osm, round(m, 3)) for k, (_, osm, m) in enumerate(want)]


@pytest.mark.parametrize("every_ms, rows_a_slice", [(40, 100), (400, 7), (30_000, 50)])
def test_search_budget_in_slices(spark, every_ms, rows_a_slice):
    """As one by one, wherever slices begin, also within a window and where searches never thin out; equal times by seq. The
    job needs no set of rows for each round."""
    rnd = random.Random(every_ms)
    at, want, held = 0, {}, []
    rows = []
    for seq in range(900):
        at += rnd.choice([0, 1, 2]) * every_ms
        rows.append((seq, at))
        held = [t for t in held if t > at - 60_000]
        want[seq] = ("refused", held[0] + 60_000 - at) if len(held) >= 6 else ("admitted", None)
        if len(held) < 6:
            held.append(at)
    rnd.shuffle(rows)
    got = rd.search_budget(spark.createDataFrame([*rows, (-1, None)], "seq long, saved_ms long"), rd.Limit(6, 60_000), rows_a_slice)
    assert {r.seq: (r.status, r.retry_after_ms) for r in got.collect()} == want


def test_pairs_of_one_key_are_spread(spark):
    """All pairs, in many tasks though a single key has them; keys that are null or on one side have none."""
    from hushgrid.plans.shared import spread_pairs

    many = spark.range(600).select("id", F.when(F.col("id") < 500, "a").when(F.col("id") < 550, "b").alias("k"))
    few = spark.range(40).select(F.col("id").alias("other"), F.when(F.col("id") < 30, "a").when(F.col("id") < 35, "c").alias("k"))
    got = spread_pairs(many, few, "k").select("id", "other", "k", F.spark_partition_id().alias("task")).toPandas()
    assert set(zip(got.id, got.other)) == {(i, o) for i in range(500) for o in range(30)} and len(got) == 15_000 and set(got.k) == {"a"}
    assert got.task.nunique() > 6 and got.task.value_counts().max() < 5_000


def test_a_tile_comes_in_batches(spark):
    """A worker never gets the rows of a tile as one group, and a tile put together from batches, that cut through blocks too, is
    what its edges are."""
    rows = [(f"{0x8A2830828007FFF + (k // 7 << 15):015x}", 5, 6, k % 50 - 20, -k, k % 50, -k // 2, k % 2) for k in range(3000)]
    a, b = (np.array([r[at + 1] << 32 | r[at] & 0xFFFFFFFF for r in rows]) for at in (3, 5))
    cells, flags, codes = np.array([r[0] for r in rows], object), np.array([r[7] for r in rows]), np.arange(3000) // 7 % 900 + 1
    tile = wg._Tile((5, 6))
    for k, to in ((0, 5), (5, 700), (700, 701), (701, 3000)):
        tile.add(a[k:to], b[k:to], flags[k:to], cells[k:to], codes[k:to])
    row = tile.row().to_pylist()[0]
    t = wg.decode_tile(row["data"])
    ends = t["nodes"][t["ends"]].reshape(-1, 4).tolist()
    assert ends == [list(r[3:7]) for r in rows] and t["flags"].tolist() == flags.tolist() and [f"{c:015x}" for c in t["cells"][t["block"]]] == cells.tolist()
    assert t["codes"][t["block"]].tolist() == codes.tolist() and (row["n_edges"], row["n_blocks"], row["n_nodes"]) == (3000, 429, len({tuple(x) for e in ends for x in (e[:2], e[2:])}))
    pieces = spark.createDataFrame(rows, PIECE).withColumns({"kind": F.lit("modeled"), "laeq24h": F.lit(61.5)})
    for df in (wg.build_tiles(pieces), wg.node_components(pieces)):
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    read = wg.read_tiles(wg.build_tiles(pieces))
    assert sorted((r.cell, r.from_lng, r.from_lat, r.to_lng, r.to_lat, r.flags) for r in read.collect()) == sorted((r[0], *r[3:]) for r in rows)
    assert [r.edge_no for r in read.orderBy("edge_no").collect()] == list(range(3000))


def test_networks_of_edges():
    """Every node with the smallest that it reaches, on chains in any order and on random edges."""
    rng = np.random.default_rng(3)
    chain = rng.permutation(5000)
    for a, b in ((chain[:-1], chain[1:]), rng.integers(0, 4000, (2, 2500)), (np.array([7]), np.array([7]))):
        above = {}

        def top(x):
            while above.setdefault(x, x) != x:
                x = above[x]
            return x

        for u, v in zip(a.tolist(), b.tolist()):
            ru, rv = top(u), top(v)
            above[max(ru, rv)] = min(ru, rv)
        nodes, number, own = wg._networks(a, b)
        assert nodes[number].tolist() == [*a, *b] and {n: nodes[o] for n, o in zip(nodes.tolist(), own)} == {n: top(n) for n in nodes.tolist()}


def test_guards_read_the_graph_once(spark, tmp_path):
    from hushgrid.plans import queries

    p = queries.QUERIES["a13_guards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in p and "l_partkey" not in p


def test_a_center_that_comes_twice_is_inside_once(spark, tmp_path):
    """The SQL counts a center's edges once, as the query does, however often the center comes."""
    import duckdb

    from hushgrid.plans import queries

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").createOrReplaceTempView("hg_part")
    spark.sql("SELECT p_partkey, CAST(p_size % 30 AS INT) AS p_size FROM hg_part CROSS JOIN range(2)").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    for t in ("part", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("j3_street_level", "j4_cell_cards", "j5_f15_levels"):
        got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
        want = c.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
        text = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).astype(str).replace({"<NA>": "None", "nan": "None"}).to_numpy().tolist()))
        assert [x.replace(".0'", "'") for x in text(got)] == [x.replace(".0'", "'") for x in text(want)] and (got.kind == "below-floor").any()


def test_facts_of_a_cell_in_one_worker(spark):
    """As the functions that stand alone say, and in one evaluation; null without a place."""
    p = spark.createDataFrame([(37.7 + k * 0.003, -122.5 + k * 0.002) for k in range(40)] + [(None, -122.0)], "lat double, lng double")
    one = p.select("lat", ve.cell_facts("lat", "lng", F.col("lat") + 0.001, "lng").alias("f")).select("lat", "f.*")
    q = p.where("lat IS NOT NULL").withColumn("cell", ve.cell_of("lat", "lng", F.lit(10)))
    slow = q.select("cell", ve.cell_center("cell").alias("c"), F.size(ve.cell_boundary("cell")).alias("corners"), ve.grid_distance("cell", ve.cell_of(F.col("lat") + 0.001, "lng", F.lit(10))).alias("steps"))
    assert sorted((r.cell, r.c.lat, r.c.lng, r.corners, r.steps) for r in slow.collect()) == sorted((r["cell"], r[2], r[3], r.corners, r.steps) for r in one.where("cell IS NOT NULL").collect())
    assert [tuple(r)[1:] for r in one.where("cell IS NULL").select(F.lit(0), "cell", "corners", "steps").collect()] == [(None, None, None)]
    from hushgrid.plans import queries

    plan = queries.QUERIES["f10_f13_cells_of_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
