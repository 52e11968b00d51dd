"""Domain tables derived from the given ones by arithmetic that Spark and DuckDB share.

Each adapter has the same derivation as SQL text for the oracles: SQL[name] is a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table

#: Prefix of the blocks of region 85283083fffffff: resolution 10, digits 6 to 10 free.
REGION, PREFIX = "85283083fffffff", 622203768913559551
#: Places of the digits 6 to 10 and their weights in base 7.
_digits = [(2401, 27), (343, 24), (49, 21), (7, 18), (1, 15)]


def cell(n: Column) -> Column:
    """The n-th block of the region (n below 7 ** 5)."""
    out = F.lit(PREFIX)
    for weight, shift in _digits:
        out = out + F.floor(n / weight) % 7 * (1 << shift)
    return F.lower(F.hex(out.cast("long")))


def cell_sql(n: str) -> str:
    parts = " + ".join(f"(({n}) // {w} % 7) * {1 << s}" for w, s in _digits)
    return f"lower(hex(CAST({PREFIX} + {parts} AS BIGINT)))"


def millis(ts: str = "ts") -> Column:
    """Milliseconds of a time without zone, read as UTC whatever the session's zone is."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 1000)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = e.select(F.col("event_id").alias("seq"), "user_id", k.alias("k"), millis().alias("saved_ms"), F.col("ts").cast("timestamp").alias("arrived"), "event_type", "value", F.hour("ts").alias("hour"))
    laeq = 40 + F.col("value") / 10
    return e.select(
        "seq", "user_id", F.col("k").alias("client_id"), cell(F.col("user_id") % 49).alias("cell"), cell((37 * F.col("user_id") + F.col("k")) % 16807).alias("far_cell"),
        "saved_ms", "arrived", (F.col("saved_ms") - 60_000 + F.when(F.col("seq") % 50 == 0, 3_600_000).otherwise(0)).alias("at_ms"),
        laeq.alias("laeq"), (laeq + F.col("k") / 5.0).alias("lamax"), (laeq + F.col("k") / 10.0).alias("l10"), (laeq - F.col("k") / 10.0).alias("l90"),
        F.when(F.col("event_type") == "error", 12.5).otherwise(30.0).alias("duration_sec"), F.col("event_type").alias("model"),
        F.when(F.col("seq") % 97 == 0, 10.0).otherwise(120.0).alias("offset_db"), F.concat(F.lit("node/"), F.col("k") % 7).alias("osm_id"), "hour",
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue searches: the readings of which k is a multiple of 5 also searched their block, and found two venues."""
    r = readings(spark, sf_dir).where("client_id % 5 = 0")
    venue = lambda d: F.concat(F.lit("node/"), (F.col("client_id") + d) % 7)
    one = lambda d: F.struct(venue(d).alias("osm_id"), F.concat(F.lit("venue "), venue(d)).alias("name"))
    return r.select("cell", (F.col("saved_ms") - 1).alias("fetched_ms"), F.array(one(0), one(1)).alias("venues"))


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each model that suppliers 0 to 3 stand for."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 4")
    names = F.array(*(F.lit(m) for m in ("click", "view", "signup", "other")))
    model = F.element_at(names, (F.col("s_suppkey") + 1).cast("int"))
    return s.select(model.alias("model"), F.concat(model, F.lit("/2026-10")).alias("id"), (118 + F.col("s_nationkey") % 5).cast("double").alias("offset_db"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((45 + F.col("l_quantity")).alias("db"), cell(F.col("l_partkey") * 7 % 16807).alias("cell"), *_place(li))


def _place(li: DataFrame) -> list[Column]:
    return [(-122.52 + F.col("l_partkey") % 1000 * 0.00015).alias("lng"), (37.7 + F.col("l_suppkey") % 100 * 0.001).alias("lat")]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(cell(F.col("p_partkey") % 16807).alias("cell"), (45.0 + F.col("p_size")).alias("laeq"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("node/"), "s_suppkey").alias("osm_id"), (-122.45 + F.col("s_suppkey") % 40 * 0.0004).alias("lng"), (37.75 + F.floor(F.col("s_suppkey") / 40) % 40 * 0.0004).alias("lat"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block centers around the venues."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(cell(k % 16807).alias("cell"), (-122.451 + k % 45 * 0.0004).alias("lng"), (37.7495 + F.floor(k / 45) % 45 * 0.0004).alias("lat"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("point_id"), (-122.5 + F.col("o_custkey") % 100 * 0.002 + 0.0003).alias("lng"), (37.7 + F.col("o_orderkey") % 97 * 0.002 + 0.0007).alias("lat"))


#: Fixed rings for polygon tests: one with a hole, one beside it.
RINGS = [
    ("a", [(-122.48, 37.72), (-122.4, 37.71), (-122.39, 37.83), (-122.47, 37.84), (-122.48, 37.72)]),
    ("a", [(-122.45, 37.75), (-122.43, 37.75), (-122.43, 37.79), (-122.45, 37.79), (-122.45, 37.75)]),
    ("b", [(-122.38, 37.7), (-122.33, 37.7), (-122.36, 37.88), (-122.38, 37.7)]),
]


def shore(spark: SparkSession) -> DataFrame:
    from ..functions.geo import polygon_edges

    rows = [(p, [list(xy) for xy in ring]) for p, ring in RINGS]
    return polygon_edges(spark.createDataFrame(rows, "poly_id string, ring array<array<double>>"))


#: Street grids: quarters of 8 by 8 corners, about 90 by 100 meters apart, 4 by 4 of them a district, 40 districts in a row.
#: Each supplier is a quarter, so the city grows with the tables.
QUARTER, DISTRICT, ACROSS = 8, 4, 40


def _corner(quarter: Column, i: Column, j: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Of a quarter's corner: its district's column and row, its place in the district, and a number for its block."""
    d, q = F.floor(quarter / DISTRICT**2), quarter % DISTRICT**2
    x, y = q % DISTRICT * QUARTER + i, F.floor(q / DISTRICT) * QUARTER + j
    return d % ACROSS, F.floor(d / ACROSS), x, y, d * (QUARTER * DISTRICT) ** 2 + x * (QUARTER * DISTRICT) + y


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets between the corners of the grids."""
    li = table(spark, sf_dir, "lineitem")
    east = F.col("l_linenumber") % 2 == 1
    dx, dy, x, y, block = _corner(F.col("l_suppkey"), F.col("l_partkey") % QUARTER, F.floor(F.col("l_partkey") / QUARTER) % QUARTER)
    lng, lat = -1224200000 + dx * 500000 + x * 10000, 377000000 + dy * 400000 + y * 9000
    return li.select(
        cell(block % 16807).alias("cell"), lng.cast("int").alias("from_lng"), lat.cast("int").alias("from_lat"),
        (lng + F.when(east, 10000).otherwise(0)).cast("int").alias("to_lng"), (lat + F.when(east, 0).otherwise(9000)).cast("int").alias("to_lat"),
        F.when(F.col("l_quantity") <= 2, 1).otherwise(0).alias("flags"),
    )


def way_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of ways: three nodes each, a tag of every kind; nodes on shared points."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kinds = F.array(*(F.lit(x) for x in ("residential", "footway", "motorway", "steps", "path")))
    tags = F.concat(F.lit("Thighway="), F.element_at(kinds, (k % 5 + 1).cast("int")), F.when(k % 11 == 0, ",bridge=yes").when(k % 13 == 0, ",tunnel=yes").when(k % 17 == 0, ",layer=2").otherwise(""), F.when(k % 7 == 0, ",foot=no").otherwise(""), F.when(k % 19 == 0, ",name=A%20%B").otherwise(""))
    node = lambda d: F.concat(F.lit("n"), k * 3 + d, F.lit("x"), F.format_string("%.4f", (F.col("o_custkey") % 300 + d) * 0.0005 - 122.5), F.lit("y"), F.format_string("%.4f", (k % 50) * 0.0005 + 37.7))
    return o.select(k.alias("way_id"), F.concat(F.lit("w"), k, F.lit(" "), tags, F.lit(" N"), node(0), F.lit(","), node(1), F.lit(","), node(2)).alias("value"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip of each order, from the customer's corner to another one of the district, one to four kilometers; some of them
    over far."""
    o = table(spark, sf_dir, "orders")
    k, c, side = F.col("o_orderkey"), F.col("o_custkey"), QUARTER * DISTRICT
    dx, dy, x, y, _ = _corner(F.floor(c / 15), c % QUARTER, F.floor(c / QUARTER) % QUARTER)
    place = lambda x, y: (-122.42 + dx * 0.05 + x * 0.001 + 0.0001, 37.7 + dy * 0.04 + y * 0.0009 + 0.0001)
    lng, lat = place(x, y)
    to_lng, to_lat = place((x + 11 + c % 13) % side, (y + 7 + c % 5) % side)
    return o.select(k.cast("string").alias("trip_id"), lng.alias("from_lng"), lat.alias("from_lat"), (to_lng + F.when(k % 350 == 0, 0.2).otherwise(0)).alias("to_lng"), to_lat.alias("to_lat"))


SQL = {
    "readings": f"""readings AS (SELECT event_id AS seq, user_id, k AS client_id, {cell_sql('user_id % 49')} AS cell, {cell_sql('(37 * user_id + k) % 16807')} AS far_cell,
        saved_ms, ts AS arrived, saved_ms - 60000 + CASE WHEN event_id % 50 = 0 THEN 3600000 ELSE 0 END AS at_ms, 40 + value / 10 AS laeq, 40 + value / 10 + k / 5.0 AS lamax,
        40 + value / 10 + k / 10.0 AS l10, 40 + value / 10 - k / 10.0 AS l90, CASE WHEN event_type = 'error' THEN 12.5 ELSE 30.0 END AS duration_sec, event_type AS model,
        CASE WHEN event_id % 97 = 0 THEN 10.0 ELSE 120.0 END AS offset_db, 'node/' || (k % 7) AS osm_id, CAST(hour(ts) AS INTEGER) AS hour
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS saved_ms FROM events))""",
    "searches": "searches AS (SELECT cell, saved_ms - 1 AS fetched_ms, ['node/' || (client_id % 7), 'node/' || ((client_id + 1) % 7)] AS listed FROM readings WHERE client_id % 5 = 0)",
    "calibrations": "calibrations AS (SELECT m AS model, m || '/2026-10' AS id, CAST(118 + s_nationkey % 5 AS DOUBLE) AS offset_db FROM (SELECT *, ['click', 'view', 'signup', 'other'][s_suppkey + 1] AS m FROM supplier WHERE s_suppkey < 4))",
    "pixels": f"pixels AS (SELECT 45 + l_quantity AS db, {cell_sql('l_partkey * 7 % 16807')} AS cell, -122.52 + l_partkey % 1000 * 0.00015::DOUBLE AS lng, 37.7 + l_suppkey % 100 * 0.001::DOUBLE AS lat FROM lineitem)",
    "blocks": f"blocks AS (SELECT {cell_sql('p_partkey % 16807')} AS cell, CAST(45 + p_size AS DOUBLE) AS laeq FROM part)",
    "venues": "venues AS (SELECT 'node/' || s_suppkey AS osm_id, -122.45::DOUBLE + s_suppkey % 40 * 0.0004::DOUBLE AS lng, 37.75::DOUBLE + s_suppkey // 40 % 40 * 0.0004::DOUBLE AS lat FROM supplier)",
    "centers": f"centers AS (SELECT {cell_sql('p_partkey % 16807')} AS cell, -122.451::DOUBLE + p_partkey % 45 * 0.0004::DOUBLE AS lng, 37.7495::DOUBLE + p_partkey // 45 % 45 * 0.0004::DOUBLE AS lat FROM part)",
    "points": "points AS (SELECT o_orderkey AS point_id, -122.5::DOUBLE + o_custkey % 100 * 0.002::DOUBLE + 0.0003::DOUBLE AS lng, 37.7::DOUBLE + o_orderkey % 97 * 0.002::DOUBLE + 0.0007::DOUBLE AS lat FROM orders)",
    "edges": f"""edges AS (SELECT {cell_sql('(d * 1024 + x * 32 + y) % 16807')} AS cell, CAST(-1224200000 + d % 40 * 500000 + x * 10000 AS INTEGER) AS from_lng, CAST(377000000 + d // 40 * 400000 + y * 9000 AS INTEGER) AS from_lat,
        CAST(-1224200000 + d % 40 * 500000 + x * 10000 + CASE WHEN east THEN 10000 ELSE 0 END AS INTEGER) AS to_lng, CAST(377000000 + d // 40 * 400000 + y * 9000 + CASE WHEN east THEN 0 ELSE 9000 END AS INTEGER) AS to_lat,
        CASE WHEN l_quantity <= 2 THEN 1 ELSE 0 END AS flags FROM (SELECT l_suppkey // 16 AS d, l_suppkey % 16 % 4 * 8 + l_partkey % 8 AS x, l_suppkey % 16 // 4 * 8 + l_partkey // 8 % 8 AS y, l_linenumber % 2 = 1 AS east, l_quantity FROM lineitem))""",
    "poly": "poly AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for p, r in RINGS for a, b in zip(r, r[1:], strict=False)) + ") t(poly_id, ax, ay, bx, yb))",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
