"""Releases of walking tiles: staged, audited as they were written, and published only if no guard is violated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import stored
from ..sources.text import parse_ways
from . import walk_graph as wg
from .routes import _tile
from .street_noise import street_level

#: Tiles of an area are one folder: two to the power of SHIFT in a row.
SHIFT = 4
TILES = "tile_x int, tile_y int, n_nodes long, n_edges long, n_blocks long, data binary"


class GuardsViolatedError(ValueError):
    """A release that must not be published."""


def pieces_of_ways(lines: DataFrame, blocks: DataFrame, shore: DataFrame) -> DataFrame:
    """Ways (text lines, column value) to pieces with tile, kind and laeq24h: walkable ways, levels set apart, segments, cut at
    blocks, each once, with the level of their block. blocks: cell, laeq; shore: polygon edges."""
    refs = stored(wg.node_refs(parse_ways(lines).where(wg.walkable())))
    pieces = wg.union_pieces(wg.split_at_blocks(wg.segments(wg.separate_levels(refs))))
    return street_level(pieces, blocks, shore)


def _filed(tiles: DataFrame) -> DataFrame:
    """tiles with their area, and their place within it on a curve that keeps near tiles together."""
    bit = lambda c, k: F.shiftright(F.col(c), k).bitwiseAND(1)
    curve = sum((F.shiftleft(bit("tile_x", k), 2 * k) + F.shiftleft(bit("tile_y", k), 2 * k + 1) for k in range(1, SHIFT)), bit("tile_x", 0) + F.shiftleft(bit("tile_y", 0), 1))
    return tiles.withColumns({"area_x": F.shiftright("tile_x", SHIFT), "area_y": F.shiftright("tile_y", SHIFT), "hg_place": curve})


def write_tiles(tiles: DataFrame, path: str) -> None:
    """One folder for each area, its tiles in order: a box or a trip reads the areas that it touches, and of their files the row
    groups. An area has a bounded number of tiles."""
    filed = _filed(tiles).repartition("area_x", "area_y").sortWithinPartitions("area_x", "area_y", "hg_place")
    filed.drop("hg_place").write.mode("overwrite").partitionBy("area_x", "area_y").parquet(path)


def stored_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{TILES}, area_x int, area_y int").parquet(path)


def tiles_in_box(tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Stored tiles that a box (west, south, east, north) overlaps. Ranges of areas reach the list of folders, ranges of
    tiles the files. Missing tiles are left out."""
    west, south, east, north = box
    (x0, y0), (x1, y1) = _tile(west, north), _tile(east, south)
    areas = F.col("area_x").between(x0 >> SHIFT, x1 >> SHIFT) & F.col("area_y").between(y0 >> SHIFT, y1 >> SHIFT)
    return tiles.where(areas & F.col("tile_x").between(x0, x1) & F.col("tile_y").between(y0, y1))


def tiles_of_trips(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored tiles that trips touch (wanted: x, y), each once. Only folders of their areas are listed, as long as Spark
    finds the areas few enough to send them to all tasks."""
    asked = wanted.select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y")).where("tile_x >= 0").distinct()
    areas = asked.select(F.shiftright("tile_x", SHIFT).alias("area_x"), F.shiftright("tile_y", SHIFT).alias("area_y")).distinct()
    return tiles.join(areas, ["area_x", "area_y"], "left_semi").join(asked, ["tile_x", "tile_y"], "left_semi")


class Releases:
    """Releases under one folder. `published` holds a small file for each release that was published, numbered; the one with the
    largest number is current. A release is written under its name, audited from what was written, and published by
    moving such a file into place. So a violated guard or a kill leaves the one before readable, and what isn't published is
    written again."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def published(self) -> list[str]:
        """Names of the releases, in order of publication."""
        path, fs = self._path("published")
        if not fs.exists(path):
            return []
        numbered = (f.getPath().getName().split("-", 1) for f in fs.listStatus(path))
        return [name for _, name in sorted((int(n), name[0]) for n, *name in numbered if n.isdigit())]

    def current(self) -> DataFrame | None:
        """Tiles of the release published last."""
        names = self.published()
        return stored_tiles(self.spark, f"{self.folder}/{names[-1]}/tiles") if names else None

    def stage(self, name: str, pieces: DataFrame) -> None:
        if name in self.published():
            raise ValueError(f"{name} is published")
        write_tiles(wg.build_tiles(pieces), f"{self.folder}/{name}/tiles")

    def audit(self, name: str) -> DataFrame:
        """One row of a staged release: corrupt tiles, edges, and what the guards look at, read from its own tiles."""
        read = stored(wg.read_tiles(stored_tiles(self.spark, f"{self.folder}/{name}/tiles")))
        code = F.col("code")
        edges = read.where("error IS NULL").withColumn("kind", F.when(code == 0, "below-floor").when(code == 65535, "not-covered").otherwise("modeled"))
        rows = wg.graph_stats(edges).select("n_edges", "modeled_share").join(wg.component_report(wg.node_components(edges)).select("crossing_share")).join(wg.spanning(edges))
        out = rows.join(read.agg(F.count("error").alias("corrupt")))  # one row each
        out.write.mode("overwrite").parquet(f"{self.folder}/{name}/audit")
        return self.audited(name)

    def audited(self, name: str) -> DataFrame:
        """The audit of a release as it was written last."""
        return self.spark.read.parquet(f"{self.folder}/{name}/audit")

    def publish(self, name: str) -> None:
        """GuardsViolatedError if a guard is violated or a tile is corrupt."""
        audit = self.audit(name)
        bad = [f"{r.name} {r.value} against {r.bound}" for r in wg.guard(audit).collect()]
        corrupt = audit.first().corrupt
        if bad or corrupt:
            raise GuardsViolatedError(f"{name}: " + ", ".join([*bad, *([f"{corrupt} corrupt tiles"] if corrupt else [])]))
        self._point(name)

    def _point(self, name: str) -> None:
        path, fs = self._path("published")
        new, _ = self._path(f"published/.{uuid.uuid4().hex}")
        fs.mkdirs(path)
        fs.create(new, True).close()
        to, _ = self._path(f"published/{len(self.published()) + 1}-{name}")
        if not fs.rename(new, to):
            raise OSError(f"can't publish {to}")

    def release(self, name: str, pieces: DataFrame) -> DataFrame:
        """Stages, audits and publishes; the current tiles."""
        self.stage(name, pieces)
        self.publish(name)
        return self.current()

