"""Sound levels as Column functions. Only energies add up; decibels are the last step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bands of loudness, quietest first, each below its upper edge.
BANDS = [
    ("Very quiet", 45.0, "<45", "#1A9850"),
    ("Quiet", 55.0, "45–55", "#66BD63"),
    ("Moderate", 65.0, "55–65", "#E3A21A"),
    ("Loud", 75.0, "65–75", "#F46D43"),
    ("Very loud", None, "75+", "#C62828"),
]
#: Seconds of a level frame, and the offset of a phone model without calibration.
FRAME_SECONDS, DEFAULT_OFFSET = 0.125, 120.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def energy_of(db: Column | str) -> Column:
    return F.pow(F.lit(10.0), _c(db) / 10)


def level_of(energy: Column | str) -> Column:
    """Null for no energy."""
    return 10 * F.log10(_c(energy))


def energy_avg(db: Column | str) -> Column:
    """Aggregate: the level of the mean energy; combines on the map side."""
    return level_of(F.avg(energy_of(db)))


def round_to(x: Column | str, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(_c(x) * scale + 0.5) / F.lit(scale)


def is_finite(x: Column | str) -> Column:
    c = _c(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def loudness_band(laeq: Column | str) -> Column:
    """struct(label, color, range, order); null for a null level."""
    c, out = _c(laeq), None
    for n, (label, upper, text, color) in enumerate(BANDS):
        band = F.struct(F.lit(label).alias("label"), F.lit(color).alias("color"), F.lit(text).alias("range"), F.lit(n).alias("band_order"))
        test = c.isNotNull() if upper is None else c < upper
        out = F.when(test, band) if out is None else out.when(test, band)
    return out


def dbfs_of(rms: Column | str) -> Column:
    return 20 * F.log10(F.greatest(_c(rms), F.lit(1e-9)))


def db_spl(dbfs: Column | str, offset: Column | str) -> Column:
    return _c(dbfs) + _c(offset)


def summarize(frames: DataFrame, by: str | list[str], level: str = "db_spl") -> DataFrame:
    """Session summary: laeq, lamax, l10, l90 (interpolated), duration_sec, spikiness. A group is one session."""
    shares = F.percentile(level, F.array(F.lit(0.9), F.lit(0.1)))
    out = frames.groupBy(by).agg(energy_avg(level).alias("laeq"), F.max(level).alias("lamax"), shares.alias("p"), (F.count(level) * FRAME_SECONDS).alias("duration_sec"))
    return out.withColumns({"l10": F.col("p")[0], "l90": F.col("p")[1]}).drop("p").withColumn("spikiness", F.col("l10") - F.col("l90"))


def calibrate(rows: DataFrame, calibrations: DataFrame, model: str = "model") -> DataFrame:
    """Adds offset_db and calibration_id: those of the model, else the default and null. Calibrations are one row a
    phone model; Spark broadcasts them while they are small and shuffles them otherwise."""
    c = calibrations.select(F.col("model").alias(model), F.col("id").alias("calibration_id"), F.col("offset_db").alias("own_offset"))
    return rows.join(c, model, "left").withColumn("offset_db", F.coalesce("own_offset", F.lit(DEFAULT_OFFSET))).drop("own_offset")


def calibration_offset(runs: DataFrame) -> DataFrame:
    """(model, offset_db) from runs (model, meter_laeq, app_laeq) beside a reference meter."""
    return runs.groupBy("model").agg((DEFAULT_OFFSET + F.avg(F.col("meter_laeq") - F.col("app_laeq"))).alias("offset_db"))


def recalibrate(readings: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Levels moved by the difference of the new and the stored offset; rows without a new offset stay."""
    new = calibrations.select("model", F.col("offset_db").alias("new_offset"))
    move = F.coalesce(F.col("new_offset") - F.col("offset_db"), F.lit(0.0))
    levels = {c: F.col(c) + move for c in ("laeq", "lamax", "l10", "l90") if c in readings.columns}
    return readings.join(new, "model", "left").withColumns(levels).withColumn("offset_db", F.coalesce("new_offset", "offset_db")).drop("new_offset")
