"""The walking graph: ways to segments, segments to pieces within blocks, pieces to tiles, and checks."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo, hexgrid
from ..plans.components import connected_components
from .ranks import elements_at
from .street_noise import encode_level

# Kinds of ways that can be walked, and answers to `foot` that open a closed way.
WALKABLE = [
    "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "unclassified", "residential", "living_street", "service", "pedestrian", "track", "road",
    "footway", "path", "steps", "corridor", "cycleway", "bridleway",
]
FOOT_OPENS = ["yes", "designated", "permissive"]
#: Meters: a crossing is found to within BISECT, and none lies within END of a segment's end.
BISECT, END = 0.1, 0.5
STEPS = 1
#: Guards: least share of nodes in networks that cross a tile edge, and of length in modeled blocks.
CROSSING_LEAST, MODELED_LEAST = 0.9, 0.05
MAGIC, MOST_BLOCKS = b"SMW2", 0x10000
#: Edges that a worker hands on at once, and of which it finds the networks at once.
_EDGES, NETWORK = 20_000, 500_000
_M = geo.E7 * geo.METER_PER_DEGREE


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def walkable() -> Column:
    foot, access = F.coalesce(_tag("foot"), F.lit("")), F.coalesce(_tag("access"), F.lit(""))
    return F.coalesce(_tag("highway"), F.lit("")).isin(WALKABLE) & ~foot.isin("no", "use_sidepath") & (~access.isin("no", "private") | foot.isin(FOOT_OPENS))


def way_level() -> Column:
    """An integer layer tag (also 0), else 1 for a bridge, -1 for a tunnel, else 0."""
    layer = _tag("layer").try_cast("double")
    yes = lambda name: _tag(name).isNotNull() & ~_tag(name).isin("no", "")
    return F.coalesce(F.when(layer == F.floor(layer), layer.cast("int")), F.when(yes("bridge"), 1), F.when(yes("tunnel"), -1), F.lit(0))


def locate(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Refs (way_id, pos, node_id) with the coordinates of their nodes (id, lng_e7, lat_e7); null where missing."""
    return refs.join(nodes.select(F.col("id").alias("node_id"), "lng_e7", "lat_e7"), "node_id", "left")


def node_refs(ways: DataFrame) -> DataFrame:
    """One row for each node of a way (way_id, tags, nodes): way_id, pos, node_id, lng_e7, lat_e7, level, flags."""
    flags = F.when(_tag("highway") == "steps", STEPS).otherwise(0)
    e = ways.select("way_id", way_level().alias("level"), flags.alias("flags"), F.posexplode("nodes").alias("pos", "n"))
    return e.select("way_id", "pos", F.col("n.id").alias("node_id"), F.col("n.lng_e7").alias("lng_e7"), F.col("n.lat_e7").alias("lat_e7"), "level", "flags")


def shared_points(refs: DataFrame) -> DataFrame:
    """(lng_e7, lat_e7, ids, levels) of points that several nodes share."""
    at = refs.where("lng_e7 IS NOT NULL AND lat_e7 IS NOT NULL").groupBy("lng_e7", "lat_e7")
    return at.agg(F.count_distinct("node_id").alias("ids"), F.count_distinct("level").alias("levels")).where("ids > 1")


def separate_levels(refs: DataFrame) -> DataFrame:
    """refs with the nodes that share a point, but not a level, set apart: the k-th id moves k units north, wherever
    it is used."""
    points = shared_points(refs).where("levels > 1").select("lng_e7", "lat_e7")
    ids = refs.select("lng_e7", "lat_e7", "node_id").distinct().join(points, ["lng_e7", "lat_e7"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("lng_e7", "lat_e7").orderBy("node_id")) - 1
    moved = ids.withColumn("k", rank).where("k > 0").groupBy("node_id").agg(F.max("k").alias("k"))
    return refs.join(moved, "node_id", "left").withColumn("lat_e7", (F.col("lat_e7") + F.coalesce("k", F.lit(0))).cast("int")).drop("k")


def segments(refs: DataFrame) -> DataFrame:
    """(way_id, pos, from_lng, from_lat, to_lng, to_lat, flags): neighbours on a way, the smaller point first.
    Segments without length or with an end missing drop."""
    w = Window.partitionBy("way_id").orderBy("pos")
    here = F.struct("lng_e7", "lat_e7")
    s = refs.withColumn("a", F.lag(here).over(w)).withColumn("b", here).where("pos > 0")
    s = s.where("a.lng_e7 IS NOT NULL AND a.lat_e7 IS NOT NULL AND b.lng_e7 IS NOT NULL AND b.lat_e7 IS NOT NULL AND a <> b")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return s.select("way_id", "pos", lo["lng_e7"].alias("from_lng"), lo["lat_e7"].alias("from_lat"), hi["lng_e7"].alias("to_lng"), hi["lat_e7"].alias("to_lat"), "flags")


def _cell(points: np.ndarray) -> np.ndarray:
    return hexgrid.cell_of(points[:, 1] * geo.E7, points[:, 0] * geo.E7, 10)


def _meters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mid = np.radians((a[:, 1] + b[:, 1]) * (geo.E7 / 2))
    return np.hypot((b[:, 0] - a[:, 0]) * np.cos(mid), b[:, 1] - a[:, 1]) * _M


def cut_points(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of segments (n x 2 arrays of E7): owner, from, to, cell. All spans that still hold a crossing are halved
    together, level by level; as blocks are convex, a span with both ends in one block holds none."""
    start, end = start.astype(float), end.astype(float)
    owner = np.arange(len(start))
    a, b, ca, cb = start, end, _cell(start), _cell(end)
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    keep = ca != cb
    owner, a, b, ca, cb = owner[keep], a[keep], b[keep], ca[keep], cb[keep]
    while len(owner):
        mid = (a + b) / 2
        small = _meters(a, b) <= BISECT
        if small.any():
            cuts.append((owner[small], np.floor(mid[small] + 0.5)))
        big = ~small
        owner, a, b, ca, cb, mid = owner[big], a[big], b[big], ca[big], cb[big], mid[big]
        if not len(owner):
            break
        cm = _cell(mid)
        owner, a, b, ca, cb = np.concatenate((owner, owner)), np.concatenate((a, mid)), np.concatenate((mid, b)), np.concatenate((ca, cm)), np.concatenate((cm, cb))
        keep = ca != cb
        owner, a, b, ca, cb = owner[keep], a[keep], b[keep], ca[keep], cb[keep]
    if cuts:
        own, at = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
        ok = (_meters(start[own], at) > END) & (_meters(at, end[own]) > END)
        own, at = own[ok], at[ok]
        along = np.hypot(*(at - start[own]).T)
        order = np.lexsort((along, own))
        own, at = own[order], at[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1]).any(1))) if len(own) else np.zeros(0, bool)
        own, at = own[new], at[new]
    else:
        own, at = np.zeros(0, np.int64), np.zeros((0, 2))
    who = np.concatenate((np.arange(len(start)), own))
    begin = np.concatenate((start, at))
    order = np.lexsort((np.hypot(*(begin - start[who]).T), who))
    who, begin = who[order], begin[order]
    last = np.append(who[1:] != who[:-1], True)
    finish = np.where(last[:, None], end[who], np.roll(begin, -1, axis=0))
    return who, begin.astype(np.int64), finish.astype(np.int64), _cell((begin + finish) / 2)


def split_at_blocks(segs: DataFrame) -> DataFrame:
    """Pieces (cell, tile_x, tile_y, from_lng, from_lat, to_lng, to_lat, flags) of segments, cut where they cross into
    another block. A piece has the block of its midpoint and the tile of its first point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = [t.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if len(c[0]):
                who, a, b, cell = cut_points(np.stack(c[:2], 1), np.stack(c[2:4], 1))
                yield pa.RecordBatch.from_arrays([pa.array([f"{x:015x}" for x in cell]), *(pa.array(x.astype(np.int32)) for x in (*a.T, *b.T, c[4][who]))], names=["cell", "from_lng", "from_lat", "to_lng", "to_lat", "flags"])

    p = segs.select("from_lng", "from_lat", "to_lng", "to_lat", "flags").mapInArrow(run, "cell string, from_lng int, from_lat int, to_lng int, to_lat int, flags int")
    return p.withColumn("t", geo.walk_tile("from_lng", "from_lat")).select("cell", F.col("t.x").alias("tile_x"), F.col("t.y").alias("tile_y"), "from_lng", "from_lat", "to_lng", "to_lat", "flags")


def union_pieces(*parts: DataFrame) -> DataFrame:
    """Pieces of several extracts, equal rows once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def with_levels(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces with their block's modeled level, or null."""
    return pieces.join(blocks.select("cell", "laeq"), "cell", "left")


# Tiles. Layout, little-endian: magic, u32 counts of nodes, edges, blocks; i32 coordinates of the nodes; u32 ends of
# the edges; u16 block of each edge; u8 flags, padded to four bytes; for each block u32 high, u32 low, u16 level.
def encode_tile(nodes: np.ndarray, ends: np.ndarray, block: np.ndarray, flags: np.ndarray, cells: list[int], codes: list[int]) -> bytes:
    if len(cells) > MOST_BLOCKS:
        raise ValueError(f"{len(cells)} blocks in a tile")
    pad = -(16 + 8 * len(nodes) + 11 * len(block)) % 4
    return b"".join([
        struct.pack("<4s3I", MAGIC, len(nodes), len(block), len(cells)), nodes.astype("<i4").tobytes(), ends.astype("<u4").tobytes(),
        block.astype("<u2").tobytes(), flags.astype("u1").tobytes(), bytes(pad), *(struct.pack("<IIH", c >> 32, c & 0xFFFFFFFF, v) for c, v in zip(cells, codes, strict=True)),
    ])


class _Tile:
    """A tile that is put together from batches of its edges, which come ordered by cell. An edge takes 19 bytes until the tile is
    whole. A point is one number, of which the bytes are those of the layout."""

    def __init__(self, place: tuple[int, int]) -> None:
        self.place, self.a, self.b, self.block, self.flags, self.cells, self.codes = place, [], [], [], [], [], []

    def add(self, a: np.ndarray, b: np.ndarray, flags: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> None:
        new = np.append(not self.cells or cells[0] != self.cells[-1], cells[1:] != cells[:-1])
        number = len(self.cells) - 1 + np.cumsum(new)
        self.cells.extend(cells[new].tolist())
        self.codes.extend(codes[new].tolist())
        if len(self.cells) > MOST_BLOCKS:
            raise ValueError(f"more than {MOST_BLOCKS} blocks in a tile")
        for held, x in ((self.a, a), (self.b, b), (self.block, number.astype("<u2")), (self.flags, flags.astype("u1"))):
            held.append(x)

    def row(self) -> pa.RecordBatch:
        nodes = np.concatenate(self.a + self.b)
        nodes.sort()
        n = 0
        for k in range(0, len(nodes), _EDGES):  # equal ones go in place
            part = nodes[k : k + _EDGES]
            part = part[np.append(n == 0 or part[0] != nodes[n - 1], part[1:] != part[:-1])]
            nodes[n : n + len(part)] = part
            n += len(part)
        e = sum(map(len, self.a))
        foot = b"".join(struct.pack("<IIH", int(c, 16) >> 32, int(c, 16) & 0xFFFFFFFF, v) for c, v in zip(self.cells, self.codes, strict=True))
        data = bytearray(16 + 8 * n + 11 * e + -(8 * n + 11 * e) % 4 + len(foot))
        struct.pack_into("<4s3I", data, 0, MAGIC, n, e, len(self.cells))
        points = np.frombuffer(data, "<i8", n, 16)
        points[:] = nodes[:n]
        del nodes
        ends = np.frombuffer(data, "<u4", 2 * e, 16 + 8 * n).reshape(-1, 2)
        block, flag = np.frombuffer(data, "<u2", e, 16 + 8 * n + 8 * e), np.frombuffer(data, "u1", e, 16 + 8 * n + 10 * e)
        at = 0
        for a, b, number, f in zip(self.a, self.b, self.block, self.flags, strict=True):
            to = at + len(a)
            ends[at:to, 0], ends[at:to, 1], block[at:to], flag[at:to] = np.searchsorted(points, a), np.searchsorted(points, b), number, f
            at = to
        data[len(data) - len(foot) :] = foot
        whole = pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, len(data)], pa.int32()).buffers()[1], pa.py_buffer(data)])
        ints = [pa.array([x], pa.int32()) for x in self.place] + [pa.array([x], pa.int64()) for x in (n, e, len(self.cells))]
        return pa.RecordBatch.from_arrays([*ints, whole], names=["tile_x", "tile_y", "n_nodes", "n_edges", "n_blocks", "data"])


def decode_tile(data: bytes | pa.Buffer) -> dict[str, np.ndarray]:
    """The arrays of a tile; ValueError if it is corrupt."""
    if len(data) < 16 or data[:4] != MAGIC:
        raise ValueError("not a tile")
    n, e, b = struct.unpack_from("<3I", data, 4)
    at = 16 + 8 * n + 11 * e
    at += -at % 4
    if len(data) != at + 10 * b:
        raise ValueError("a tile of the wrong size")
    ends = np.frombuffer(data, "<u4", 2 * e, 16 + 8 * n).reshape(-1, 2)
    block = np.frombuffer(data, "<u2", e, 16 + 8 * n + 8 * e)
    if (ends >= n).any() or (block >= b).any():
        raise ValueError("a tile with an index out of bounds")
    rows = [struct.unpack_from("<IIH", data, at + 10 * k) for k in range(b)]
    return {
        "nodes": np.frombuffer(data, "<i4", 2 * n, 16).reshape(-1, 2), "ends": ends, "block": block, "flags": np.frombuffer(data, "u1", e, 16 + 8 * n + 10 * e),
        "cells": np.array([h << 32 | low for h, low, _ in rows], np.int64), "codes": np.array([v for *_, v in rows], np.int64),
    }


def build_tiles(pieces: DataFrame) -> DataFrame:
    """(tile_x, tile_y, n_nodes, n_edges, n_blocks, data) of pieces with kind and laeq24h. Edges lie in the order of their
    coordinates, block by block. Spark sorts them and they come in batches, so a worker holds one tile's numbers, however many edges
    a tile has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for t in batches:
            x, y, a, b, flags, codes = (t.column(c).to_numpy() for c in ("tile_x", "tile_y", "a", "b", "flags", "code"))
            cells = t.column("cell").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else []
            for k, to in zip(starts, [*starts[1:], len(x)], strict=True):
                place = int(x[k]), int(y[k])
                if tile is None or tile.place != place:
                    if tile:
                        yield tile.row()
                    tile = _Tile(place)
                tile.add(a[k:to].copy(), b[k:to].copy(), flags[k:to], cells[k:to], codes[k:to])
        if tile:
            yield tile.row()

    point = lambda c: F.shiftleft(F.col(f"{c}_lat").cast("long"), 32).bitwiseOR(F.col(f"{c}_lng").cast("long").bitwiseAND(0xFFFFFFFF))
    ready = pieces.withColumn("code", encode_level("kind", "laeq24h")).repartition("tile_x", "tile_y")
    ready = ready.sortWithinPartitions("tile_x", "tile_y", "cell", "from_lng", "from_lat", "to_lng", "to_lat", "flags")
    ready = ready.select("tile_x", "tile_y", "cell", point("from").alias("a"), point("to").alias("b"), "flags", "code")
    return ready.mapInArrow(run, "tile_x int, tile_y int, n_nodes long, n_edges long, n_blocks long, data binary")


def read_tiles(tiles: DataFrame) -> DataFrame:
    """Edges of tiles (tile_x, tile_y, data): edge_no (the order within the tile), from/to coordinates, cell, flags,
    code; a corrupt tile gives one row with `error` set. A worker holds one tile at a time, and its edges are given in batches."""
    names = ["tile_x", "tile_y", "edge_no", "from_lng", "from_lat", "to_lng", "to_lat", "cell", "flags", "code", "error"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.string(), pa.int32(), pa.int32(), pa.string()]

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            for x, y, data in zip(*(p.column(c) for c in ("tile_x", "tile_y", "data")), strict=True):
                x, y = x.as_py(), y.as_py()
                try:
                    t = decode_tile(data.as_buffer() if data.is_valid else b"")
                except ValueError as e:
                    yield batch([x], [y], *([0] for _ in range(5)), [None], [0], [0], [str(e)])
                    continue
                cells = pa.array([f"{c:015x}" for c in t["cells"]], pa.string())
                for k in range(0, len(t["ends"]), _EDGES):
                    ends, block = t["ends"][k : k + _EDGES], t["block"][k : k + _EDGES]
                    a, b, n = t["nodes"][ends[:, 0]], t["nodes"][ends[:, 1]], len(ends)
                    yield batch(
                        np.full(n, x), np.full(n, y), np.arange(k, k + n), a[:, 0], a[:, 1], b[:, 0], b[:, 1], cells.take(pa.array(block)), t["flags"][k : k + _EDGES], t["codes"][block], [None] * n
                    )

    out = "tile_x int, tile_y int, edge_no long, from_lng int, from_lat int, to_lng int, to_lat int, cell string, flags int, code int, error string"
    return tiles.select("tile_x", "tile_y", "data").groupBy("tile_x", "tile_y").applyInArrow(run, out)


def graph_stats(pieces: DataFrame) -> DataFrame:
    """One row: n_edges, km, modeled_share, uncovered_share (of length), and the bounds in E7. Columns: kind."""
    m = geo.meters_between("from_lng", "from_lat", "to_lng", "to_lat")
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("m")).otherwise(0.0)) / F.sum("m")
    ends = lambda f, c: f(F.least(f"from_{c}", f"to_{c}") if f is F.min else F.greatest(f"from_{c}", f"to_{c}"))
    return pieces.withColumn("m", m).agg(
        F.count("*").alias("n_edges"), (F.sum("m") / 1000).alias("km"), part("modeled").alias("modeled_share"), part("not-covered").alias("uncovered_share"),
        ends(F.min, "lng").alias("west"), ends(F.min, "lat").alias("south"), ends(F.max, "lng").alias("east"), ends(F.max, "lat").alias("north"),
    )


def size_distribution(sizes: DataFrame, size: str = "bytes") -> DataFrame:
    """One row: n, total, median, p95, largest, where a share p is the element at floor(p n) of the sorted sizes."""
    n = sizes.where(F.col(size).isNotNull()).count()
    at = {p: max(0, min(math.floor(p * n), n - 1)) for p in (0.5, 0.95)}
    found = elements_at(sizes, size, list(at.values()))
    kind = sizes.schema[size].dataType
    pick = lambda p: F.lit(found.get(at[p])).cast(kind)
    return sizes.agg(F.count(size).alias("n"), F.sum(size).alias("total"), pick(0.5).alias("median"), pick(0.95).alias("p95"), F.max(size).alias("largest"))


def _networks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, number of each end, number of each node's smallest): networks of some edges. Networks that an edge joins take the
    smaller number, all at once, until no edge joins two."""
    nodes, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    above, (u, v) = np.arange(len(nodes)), number.reshape(2, -1)
    while len(u):
        ru, rv = above[u], above[v]
        np.minimum.at(above, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(over := above[above], above):
            above = over
        apart = above[u] != above[v]
        u, v = u[apart], v[apart]
    return nodes, number, above


def node_components(pieces: DataFrame) -> DataFrame:
    """(lng_e7, lat_e7, tile_x, tile_y, component): networks of the whole graph.

    Edges come in order of place, and a worker finds the networks of NETWORK edges at a time, so it holds no more, however
    many a tile has. Only networks that share a node go on, so the iteration over the whole runs on a much smaller graph.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t in batches:
            held.append([t.column(c).to_numpy() for c in ("tile_x", "tile_y", "a", "b")])
            n += t.num_rows
            if n >= NETWORK:
                yield from found(held)
                held, n = [], 0
        if n:
            yield from found(held)

    def found(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x, y, a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, number, own = _networks(a, b)
        tiles, tile = np.unique(x.astype(np.int64) << 32 | y, return_inverse=True)
        each = np.unique(np.concatenate((tile, tile)) * len(nodes) + number)
        for k in range(0, len(each), _EDGES):
            at, of = np.divmod(each[k : k + _EDGES], len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[of], nodes[own[of]], (tiles[at] >> 32).astype(np.int32), tiles[at].astype(np.int32))], names=["node", "own", "tile_x", "tile_y"])

    key = lambda lng, lat: F.shiftleft(F.col(lng).cast("long"), 32).bitwiseOR(F.col(lat).cast("long").bitwiseAND(0xFFFFFFFF))
    p = pieces.repartition("tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y", F.shiftright("from_lat", 15), F.shiftright("from_lng", 15))
    local = p.select("tile_x", "tile_y", key("from_lng", "from_lat").alias("a"), key("to_lng", "to_lat").alias("b")).mapInArrow(within, "node long, own long, tile_x int, tile_y int").checkpoint()
    shared = local.groupBy("node").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most").select("node", "least")
    ties = connected_components(local.join(shared, "node").where("own <> least").select("own", "least").distinct(), "own", "least").withColumnRenamed("node", "hg_own")
    out = local.join(ties, local.own == ties.hg_own, "left").select(local.node, "tile_x", "tile_y", F.coalesce("component", local.own).alias("component")).distinct()
    return out.select(F.shiftright("node", 32).cast("int").alias("lng_e7"), F.col("node").bitwiseAND(0xFFFFFFFF).cast("int").alias("lat_e7"), "tile_x", "tile_y", "component")


def component_report(nodes: DataFrame) -> DataFrame:
    """One row: nodes, networks, largest_share, crossing_share (nodes in networks that several tiles hold)."""
    each = nodes.dropDuplicates(["lng_e7", "lat_e7"]).groupBy("component").agg(F.count("*").alias("n"))
    tiles = nodes.select("component", "tile_x", "tile_y").distinct().groupBy("component").agg(F.count("*").alias("tiles"))
    j = each.join(tiles, "component")
    return j.agg(F.sum("n").alias("nodes"), F.count("*").alias("networks"), (F.max("n") / F.sum("n")).alias("largest_share"), (F.sum(F.when(F.col("tiles") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("crossing_share"))


def guard(metrics: DataFrame) -> DataFrame:
    """Violated guards of a one-row table (spanning, crossing_share, modeled_share): name, value, bound."""
    rules = F.array(
        F.struct(F.lit("spanning").alias("name"), F.col("spanning").cast("double").alias("value"), F.lit(0.0).alias("bound"), (F.col("spanning") > 0).alias("bad")),
        F.struct(F.lit("crossing").alias("name"), F.col("crossing_share").alias("value"), F.lit(CROSSING_LEAST).alias("bound"), (F.col("crossing_share") < CROSSING_LEAST).alias("bad")),
        F.struct(F.lit("modeled").alias("name"), F.col("modeled_share").alias("value"), F.lit(MODELED_LEAST).alias("bound"), (F.col("modeled_share") < MODELED_LEAST).alias("bad")),
    )
    return metrics.select(F.explode(rules).alias("g")).where("g.bad").select("g.name", "g.value", "g.bound")


def guarded(metrics: DataFrame) -> DataFrame:
    """The one row of metrics; an error when it runs if a guard is violated."""
    said = F.concat_ws(", ", F.collect_list(F.concat("name", F.lit(" "), F.col("value").cast("string"), F.lit(" against "), F.col("bound").cast("string"))))
    bad = guard(metrics).agg(said.alias("hg_bad"))  # one row, empty text if all is well
    return metrics.join(bad).where(F.when(F.col("hg_bad") != "", F.raise_error(F.concat(F.lit("guards: "), "hg_bad")).cast("boolean")).otherwise(True)).drop("hg_bad")


def spanning(pieces: DataFrame) -> DataFrame:
    """One row: pieces whose midpoint isn't in their block."""
    from .venues import cell_of

    mid = lambda c: (F.col(f"from_{c}").cast("double") + F.col(f"to_{c}")) / 2 * geo.E7
    return pieces.withColumn("own", cell_of(mid("lat"), mid("lng"), F.lit(10))).agg(F.count_if(F.col("own") != F.col("cell")).alias("spanning"))
