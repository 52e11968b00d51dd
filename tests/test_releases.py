"""Releases of tiles: one job from ways, guards that keep a bad one back, kills, and reading few files."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from hushgrid.operators import releases, routes, walk_graph as wg
from hushgrid.sources import text as tx

LNG, LAT = -122.42, 37.77


def lines(spark, n=12):
    """A street of some kilometers over several tiles, with side streets."""
    at = lambda k: f"n{k}x{LNG + 0.004 * k:.4f}y{LAT:.4f}"
    main = "w1 Thighway=residential N" + ",".join(at(k) for k in range(n))
    side = [f"w{10 + k} Thighway=footway N{at(k)},n{100 + k}x{LNG + 0.004 * k:.4f}y{LAT + 0.003:.4f}" for k in range(n)]
    closed = "w99 Thighway=motorway N" + ",".join(at(k) for k in range(3))
    return spark.createDataFrame([(x,) for x in [main, *side, closed]], "value string")


def shore(spark):
    return spark.createDataFrame([], "poly_id string, ax double, ay double, bx double, by double")


def modeled(spark):
    pieces = wg.split_at_blocks(wg.segments(wg.separate_levels(wg.node_refs(tx.parse_ways(lines(spark)).where(wg.walkable())))))
    return pieces.select("cell").distinct().withColumn("laeq", F.lit(61.3))


def edges(tiles):
    return sorted((r.from_lng, r.from_lat, r.to_lng, r.to_lat, r.cell, r.code) for r in wg.read_tiles(tiles).where("error IS NULL").collect())


def test_a_violated_guard_leaves_the_old_release(spark, tmp_path, monkeypatch):
    held = releases.Releases(spark, str(tmp_path / "r"))
    assert held.published() == [] and held.current() is None
    good = releases.pieces_of_ways(lines(spark), modeled(spark), shore(spark))
    tiles = held.release("one", good)
    want = sorted((r.from_lng, r.from_lat, r.to_lng, r.to_lat, r.cell, 613) for r in good.collect())
    assert edges(tiles) == want and len(want) > 40 and tiles.select("tile_x").distinct().count() > 2
    # Nothing modeled: it is staged and audited, not published.
    silent = releases.pieces_of_ways(lines(spark), modeled(spark).limit(0), shore(spark))
    with pytest.raises(releases.GuardsViolatedError, match="modeled 0.0 against 0.05"):
        held.release("two", silent)
    assert held.published() == ["one"] and edges(held.current()) == want
    # A corrupt tile is seen where it was written.
    broken = wg.build_tiles(good).withColumn("data", F.when(F.col("tile_x") % 2 == 0, F.expr("substring(data, 1, 20)")).otherwise(F.col("data")))
    monkeypatch.setattr(releases.wg, "build_tiles", lambda pieces: broken)
    with pytest.raises(releases.GuardsViolatedError, match="corrupt"):
        held.release("three", good)
    monkeypatch.undo()
    # Killed between audit and publication, then run again.
    with monkeypatch.context() as m:
        m.setattr(releases.Releases, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            held.release("two", good)
    assert held.published() == ["one"]
    assert edges(held.release("two", good)) == want and held.published() == ["one", "two"]
    with pytest.raises(ValueError, match="is published"):
        held.stage("one", silent)


def test_boxes_and_trips_read_few_files(spark, tmp_path):
    """Tiles of 16 by 16 areas, each a folder."""
    n = 16 << releases.SHIFT
    tiles = spark.range(n * n // 16).select((F.col("id") % n + 2048).cast("int").alias("tile_x"), (F.floor(F.col("id") / n) * 16 + 4096).cast("int").alias("tile_y"))
    tiles = tiles.select("*", *(F.lit(1).cast("long").alias(c) for c in ("n_nodes", "n_edges", "n_blocks")), F.lit(b"x").alias("data"))
    path = str(tmp_path / "tiles")
    releases.write_tiles(tiles, path)
    held = releases.stored_tiles(spark, path)
    assert len(held.inputFiles()) == 256 and held.count() == n * n // 16
    lng, lat = (2048 + 40) / 16384 * 360 - 180, 66.0
    box = (lng, lat, lng + 0.5, lat + 0.2)
    got = releases.tiles_in_box(held, box)
    (x0, y0), (x1, y1) = routes._tile(box[0], box[3]), routes._tile(box[2], box[1])
    want = {(x, y) for x in range(max(x0, 2048), min(x1, 2048 + n - 1) + 1) for y in range(y0, y1 + 1) if y % 16 == 0 and 4096 <= y < 4096 + n}
    assert {(r.tile_x, r.tile_y) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*area_x[^\]]*area_y", plan)
    read = got.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < 26
    wanted = spark.createDataFrame([(2048 + 7, 4096), (2048 + 9, 4096), (2048 + 9, 4097), (1, 1)], "x int, y int")
    some = releases.tiles_of_trips(held, wanted)
    assert {(r.tile_x, r.tile_y) for r in some.collect()} == {(2055, 4096), (2057, 4096)}
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()
