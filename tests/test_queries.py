"""Every registered query of the noise-map jobs against its oracle in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from hushgrid.functions import hexgrid
from hushgrid.operators import meter, routes, walk_graph
from hushgrid.plans import adapters as ad, queries
from hushgrid.plans.shared import stored

from .conftest import SF


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# Queries that SQL can't say, against brute force over the same tables -----------------------------------------------


def test_every_query_is_checked():
    held = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert queries.QUERIES.keys() - queries.ORACLE_SQL.keys() <= held


def wide(df):
    """Sums of coordinates don't fit into 32 bits."""
    return df.astype({c: "int64" for c in df.columns if c.startswith(("from_", "to_"))})


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def test_a7_pixel_blocks(spark):
    p = ad.pixels(spark, SF).select("lng", "lat", "db").toPandas()
    cells = [f"{c:015x}" for c in hexgrid.cell_of(p.lat.to_numpy(), p.lng.to_numpy(), 10)]
    want = (10 ** (p.db / 10)).groupby(cells).mean()
    got = run(spark, "a7_pixel_blocks").set_index("cell").laeq
    assert sorted(got.index) == sorted(want.index) and np.allclose(got[want.index], 10 * np.log10(want), atol=2e-6)


def test_f10_f13_cells_of_points(spark):
    """A point's cell is the one whose center is nearest, its center lies in itself, and cells a tenth of a mile apart are
    a step or two."""
    got = run(spark, "f10_f13_cells_of_points").merge(ad.points(spark, SF).toPandas(), on="point_id", suffixes=("", "_of"))
    assert len(got) == spark.read.parquet(f"{SF}/orders.parquet").count() and (got.corners == 7).all() and got.steps.between(0, 3).all()
    assert [f"{c:015x}" for c in hexgrid.cell_of(got.lat.to_numpy(), got.lng.to_numpy(), 10)] == got.cell.tolist()
    far = lambda lat, lng: np.hypot((lng - got.lng_of) * np.cos(np.radians(got.lat_of)), lat - got.lat_of) * 111195
    own = far(got.lat, got.lng)
    assert own.max() < 90
    around = got.drop_duplicates("cell")[["lat", "lng"]].to_numpy()
    for _, r in got.sample(60, random_state=1).iterrows():
        d = np.hypot((around[:, 1] - r.lng_of) * np.cos(np.radians(r.lat_of)), around[:, 0] - r.lat_of) * 111195
        assert d.min() == pytest.approx(np.hypot((r.lng - r.lng_of) * np.cos(np.radians(r.lat_of)), r.lat - r.lat_of) * 111195, abs=0.5)


def test_f12_trip_regions(spark):
    """Regions hold every point of the box."""
    boxes = {r.trip_id: r.box for r in routes.screened(ad.trips(spark, SF)).where("screen = 'ok'").collect()}
    got = run(spark, "f12_trip_regions").set_index("trip_id").regions
    assert set(got.index) == set(boxes)
    for t in sorted(boxes)[:150]:
        b = boxes[t]
        lat, lng = (x.ravel() for x in np.meshgrid(np.linspace(b.south, b.north, 12), np.linspace(b.west, b.east, 12)))
        assert {f"{c:015x}" for c in hexgrid.cell_of(lat, lng, 5)} <= set(got[t].split(","))


def test_g1_pieces(spark):
    """Pieces lie end to end along their segments, each in the block of its middle."""
    got = wide(run(spark, "g1_pieces"))
    mid = lambda c: ((got[f"from_{c}"] + got[f"to_{c}"]) / 2 * 1e-7).to_numpy()
    assert [f"{c:015x}" for c in hexgrid.cell_of(mid("lat"), mid("lng"), 10)] == got.cell.tolist()
    length = lambda d: np.hypot((d.to_lng - d.from_lng) * np.cos(np.radians((d.to_lat + d.from_lat) / 2e7)), d.to_lat - d.from_lat)
    segs = queries.QUERIES["w6_segments"](spark, SF).select("from_lng", "from_lat", "to_lng", "to_lat", "flags").distinct().toPandas()
    segs = wide(segs)
    # Segments that lie over each other have equal pieces, which are counted once.
    assert 0.999 < length(got).sum() / length(segs).sum() < 1.00001 and len(got) > len(segs)
    ends = lambda d, c: set(zip(d[f"{c}_lng"], d[f"{c}_lat"]))
    assert ends(segs, "from") <= ends(got, "from") and ends(segs, "to") <= ends(got, "to")


def test_a13_guards(spark):
    """Its values are those of the other reports, and a job behind the guards fails."""
    got = run(spark, "a13_guards").set_index("name")
    p = queries.levelled(spark, SF)
    e = wide(p.select("cell", "from_lng", "from_lat", "to_lng", "to_lat").toPandas())
    own = hexgrid.cell_of(((e.from_lat + e.to_lat) / 2 * 1e-7).to_numpy(), ((e.from_lng + e.to_lng) / 2 * 1e-7).to_numpy(), 10)
    want = {"spanning": sum(f"{c:015x}" != x for c, x in zip(own, e.cell)), "crossing": run(spark, "a12_components").crossing_share[0], "modeled": run(spark, "a10_graph_stats").modeled_share[0]}
    bad = {n for n, v in want.items() if (v > 0 if n == "spanning" else v < {"crossing": 0.9, "modeled": 0.05}[n])}
    assert set(got.index) == bad and bad and all(got.value[n] == pytest.approx(want[n], abs=1e-6) for n in bad)
    row = lambda *v: spark.createDataFrame([v], "spanning long, crossing_share double, modeled_share double")
    assert walk_graph.guarded(row(0, 0.95, 0.3)).count() == 1
    with pytest.raises(Exception, match="crossing 0.5"):
        walk_graph.guarded(row(0, 0.5, 0.3)).collect()


@pytest.fixture(scope="module")
def walks(spark):
    return stored(queries.planned_walks(spark, SF))


def test_g4_planned_walks(spark, walks):
    """Every walk hangs together from end to end, on edges of the graph, and none is shorter than the shortest."""
    got = walks.toPandas()
    assert rows(got.assign(meters=got.meters.round(3))[["trip_id", "outcome", "weight", "stretch_no", "meters"]]) == rows(run(spark, "g4_planned_walks")[["trip_id", "outcome", "weight", "stretch_no", "meters"]])
    planned = got[got.outcome == "planned"]
    total = planned.groupby(["trip_id", "weight"]).meters.sum().unstack()
    assert (total.min(axis=1) >= total[0.0] - 1e-6).all() and list(total.columns) == [0.0, 0.5, 1.0, 2.0, 3.0] and total.notna().all().all()
    straight = {r.trip_id: r.meters for r in routes.screened(ad.trips(spark, SF)).collect()}
    assert all(m > straight[t] - 2 * routes.SNAP for t, m in total[0.0].items())
    for _, one in planned.groupby(["trip_id", "weight"]):
        inner = one.sort_values("stretch_no").iloc[1:-1]
        assert ((inner.start - inner.end).abs() == 1).all()


def slow_choices(walks):
    """By the definition: {(trip, preset): (weight, meters, quieter, extra, detour)}."""
    route = {}
    for (t, w), one in walks[walks.outcome == "planned"].sort_values("stretch_no").groupby(["trip_id", "weight"]):
        lev = one[one.db.notna()]
        route[t, w] = one.meters.sum(), 10 * math.log10((lev.meters * 10 ** (lev.db / 10)).sum() / lev.meters.sum()) if len(lev) else None, one.edge_no.tolist()
    out = {}
    for t in {t for t, _ in route}:
        m0, l0, _ = route[t, 0.0]
        path = None
        for preset, weights, cap in routes.PRESETS:
            w = next((w for w in weights if route[t, w][0] <= m0 * (1 + cap)), None)
            if w is None or l0 is None or route[t, w][1] is None or l0 - route[t, w][1] < routes.OFFER:
                continue
            if route[t, w][2] != path:
                out[t, preset] = w, route[t, w][0], l0 - route[t, w][1], route[t, w][0] - m0, 100 * (route[t, w][0] - m0) / m0
            path = route[t, w][2]
    return out


def test_f25_choices(spark, walks):
    want = slow_choices(walks.toPandas())
    got = {(r.trip_id, r.preset): r for r in routes.choices(walks).collect()}
    assert got.keys() == want.keys() and want
    for k, (w, m, q, x, _) in want.items():
        assert got[k].weight == w and got[k].meters == pytest.approx(m) and got[k].quieter == pytest.approx(q) and got[k].extra_meters == pytest.approx(x, abs=1e-6) and got[k].noticeable == (math.floor(q + 0.5) >= 3)
    assert {(r.trip_id, r.preset) for r in queries.QUERIES["f25_choices"](spark, SF).collect()} == want.keys()


def test_a16_evaluation(spark, walks):
    w = walks.toPandas()
    offered = slow_choices(w)
    got = {r.preset: r for r in queries.QUERIES["a16_evaluation"](spark, SF).collect()}
    trips = sorted(set(w[w.outcome == "planned"].trip_id))
    for preset, *_ in routes.PRESETS:
        own = [offered.get((t, preset)) or next((offered[t, p] for p, *_ in routes.PRESETS if (t, p) in offered), None) for t in trips]
        db, detour = [o[2] if o else 0.0 for o in own], [o[4] if o else 0.0 for o in own]
        r = got[preset]
        assert (r.trips, r.n1, r.n3) == (len(trips), sum(x >= 1 for x in db), sum(x >= 3 for x in db)) and r.median_db == pytest.approx(np.median(db), abs=2e-6) and r.median_detour == pytest.approx(np.median(detour), abs=2e-6)


def test_a13_release(spark):
    """The audit of the tiles from ways, counted anew from the pieces."""
    p = wide(run(spark, "g1_pieces"))
    modeled = {r.cell for r in ad.blocks(spark, SF).select("cell").distinct().collect()}
    m = np.hypot((p.to_lng - p.from_lng) * np.cos(np.radians((p.from_lat + p.to_lat) / 2e7)), p.to_lat - p.from_lat)
    above, tiles = {}, {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for r in p.itertuples(index=False):
        a, b = (r.from_lng, r.from_lat), (r.to_lng, r.to_lat)
        above[top(a)] = top(b)
    for r in p.itertuples(index=False):
        tiles.setdefault(top((r.from_lng, r.from_lat)), set()).add((r.tile_x, r.tile_y))
    crossing = sum(len(tiles[top(n)]) > 1 for n in above) / len(above)
    got = run(spark, "a13_release").iloc[0]
    assert (got.n_edges, got.corrupt, got.spanning) == (len(p), 0, 0)
    assert got.crossing_share == pytest.approx(crossing, abs=1e-6) and got.modeled_share == pytest.approx((m * p.cell.isin(modeled)).sum() / m.sum(), abs=1e-6)
    assert got.published == (crossing >= 0.9 and got.modeled_share >= 0.05)


def test_j8_trip_measured(spark):
    cells = queries.measured(spark, SF).toPandas()
    region = [f"{(int(c, 16) & ~(15 << 52)) | (5 << 52) | (1 << 30) - 1:015x}" for c in cells.cell]
    got = run(spark, "j8_trip_measured").set_index("trip_id")
    regions = run(spark, "f12_trip_regions").set_index("trip_id").regions
    for t, text in regions.items():
        own = cells[[r in text.split(",") for r in region]]
        assert (got.cells.get(t, 0), got.readings.get(t, 0)) == (len(own), own["count"].sum())


def test_j10_within_rings(spark):
    """All pairs of a cell's southernmost, then westernmost center and a venue: at most 150 m and three steps, the nearest eight."""
    c = ad.centers(spark, SF).select("lat", "lng").toPandas()
    c["cell"] = hexgrid.cell_of(c.lat.to_numpy(), c.lng.to_numpy(), 10)
    c = c.sort_values(["lat", "lng"]).groupby("cell").first().reset_index()
    v = ad.venues(spark, SF).toPandas()
    v["own"] = hexgrid.cell_of(v.lat.to_numpy(), v.lng.to_numpy(), 10)
    want = []
    for r in c.itertuples():
        y, x = np.radians(r.lat), np.radians(v.lat)
        h = np.sin((x - y) / 2) ** 2 + np.cos(x) * np.cos(y) * np.sin(np.radians(v.lng - r.lng) / 2) ** 2
        near = v.assign(meters=2 * 6_371_008.8 * np.arcsin(np.sqrt(h)), d2=((v.lng - r.lng) * math.cos(y)) ** 2 + (v.lat - r.lat) ** 2)
        near = near[(near.meters <= 150) & (hexgrid.grid_distance(np.full(len(v), r.cell), v.own.to_numpy()) <= 3)].sort_values(["d2", "osm_id"])
        want += [(f"{r.cell:015x}", n.osm_id, k + 1, round(n.meters, 2)) for k, n in enumerate(near.head(8).itertuples())]
    got = run(spark, "j10_within_rings")
    mine = sorted((r.cell, r.rank, r.osm_id, r.meters) for r in got.itertuples())
    assert [x[:3] for x in mine] == sorted((cell, rank, osm) for cell, osm, rank, _ in want) and len(want) > 20
    meters = {(cell, osm): m for cell, osm, _, m in want}
    assert all(m == pytest.approx(meters[cell, osm], abs=0.02) for cell, _, osm, m in mine)


def test_every_order_is_a_trip(spark):
    got = {r.trip_id for r in queries.QUERIES["g4_planned_walks"](spark, SF).select("trip_id").distinct().collect()}
    assert got == {str(r.o_orderkey) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}


def test_search_budget_takes_every_reading(spark):
    assert queries.QUERIES["w4_search_budget"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_choices_are_made_once_for_trips_that_are_alike(spark):
    """Walks of as many trips as there are different ends; every trip has the rows of the one that it is like."""
    trips, walks = queries.alike_walks(spark, SF)
    all_trips = ad.trips(spark, SF)
    different = all_trips.select("from_lng", "from_lat", "to_lng", "to_lat").distinct().count()
    assert walks.select("trip_id").distinct().count() == different < all_trips.count() == trips.count()
    some = spark.createDataFrame([(r.like, "x") for r in trips.select("like").distinct().limit(3).collect()], "trip_id string, kept string")
    like = {r.trip_id: r.like for r in trips.collect()}
    chosen = {r.trip_id for r in some.collect()}
    assert {r.trip_id for r in queries.of_every_trip(trips, some).collect()} == {t for t, other in like.items() if other in chosen}
