"""Readings and frames as streams. Totals live in tables, not in state; state is bounded by watermarks on arrival."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import acoustics as ac
from ..operators.readings import BLOCK_LIMIT, USER_LIMIT, Limit, admit, attach_visits, rejection_reason
from ..plans.shared import shared_dir
from .store import Kept, Store

#: Least milliseconds before a held-back reading is tried again.
RETRY_MS = 60_000


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Everything that is there now, in micro-batches; the position is kept in a shared folder. With the same folder a
    later run goes on from there."""
    at = f"{folder or f'{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}'}/position"
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()


def signed_rollup(rows: DataFrame, keys: list[str], sign: Column | None = None) -> DataFrame:
    """(keys, energy, count): what rows add to, or with sign -1 take from, a rollup."""
    s = F.lit(1) if sign is None else sign
    return rows.groupBy(*keys).agg(F.sum(s * ac.energy_of("laeq")).alias("energy"), F.sum(s).cast("long").alias("count"))


def merged(held: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """A rollup with a delta. Rows without a reading left disappear, so nothing of their energy is left over."""
    return summed(keys)(held.unionByName(delta), True)


def summed(keys: list[str]) -> Callable[[DataFrame, bool], DataFrame]:
    """Brings parts of a rollup together. Only when no part is missing is a key without readings known to have none."""

    def merge(rows: DataFrame, whole: bool) -> DataFrame:
        out = rows.groupBy(*keys).agg(F.sum("energy").alias("energy"), F.sum("count").alias("count"))
        return out.where("count > 0") if whole else out

    return merge


def rolled(keys: list[str], key_schema: str) -> Kept:
    return Kept(f"{key_schema}, energy double, count long", summed(keys))


def rollup(stream: DataFrame, keys: list[str], key_schema: str, sign: str | None = None, folder: str | None = None) -> DataFrame:
    """Continuous rollup of a stream of readings: every micro-batch is summed and added, and sums are merged level by level.
    folder: where the table and the position live, to go on with later. Removals come after what they remove."""
    store = Store(stream.sparkSession, {"totals": rolled(keys, key_schema)}, folder and f"{folder}/rollup")
    run_to_end(stream, lambda batch, n: store.commit(n, {"totals": signed_rollup(batch, keys, F.col(sign) if sign else None)}), folder)
    return store.read("totals")


def rollup_visits(stream: DataFrame, searches: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, venue hours) of a stream of readings with osm_id and hour: a reading adds to its cell and, if its venue was
    listed by the last search of its block by then, to that venue's hour, both in one commit. searches as in attach_visits."""
    hours = ["venue_id", "hour"]
    tables = {"cells": rolled(["cell"], "cell string"), "hours": rolled(hours, "venue_id string, hour int")}
    store = Store(stream.sparkSession, tables, folder and f"{folder}/rollups")

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        visits = attach_visits(batch, searches).where("venue_id IS NOT NULL")
        store.commit(n, {"cells": signed_rollup(batch, ["cell"]), "hours": signed_rollup(visits, hours)})
        batch.unpersist()

    run_to_end(stream, each, folder)
    return store.read("cells"), store.read("hours")


def split_valid(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused with reason). Works on streams: the rules look at one row. A reading may come in late by any
    time; only one from the future is refused."""
    checked = stream.withColumn("reason", rejection_reason())
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def split_stream(stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason) of a stream, as tables: every row is in one of them, once, whenever the job is killed
    and started again with the same folder, as both get their part of a micro-batch in one commit."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    store = Store(stream.sparkSession, {"accepted": Kept(schema), "refused": Kept(f"{schema}, reason string")}, folder and f"{folder}/readings")

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        accepted, refused = split_valid(batch)
        store.commit(n, {"accepted": accepted, "refused": refused})
        batch.unpersist()

    run_to_end(stream, each, folder)
    return store.read("accepted"), store.read("refused")


def admit_stream(stream: DataFrame, user: Limit = USER_LIMIT, block: Limit = BLOCK_LIMIT, folder: str | None = None) -> DataFrame:
    """(seq, status, retry_after_ms) of a stream of readings under both limits, exact: each micro-batch is decided
    together with what was saved within the last window and with earlier saves of its own readings, so retries of
    saved readings are known however old they are. folder: where both tables and the position live, to go on with later."""
    saves = Kept("seq long, user_id long, client_id long, cell string, saved_ms long", order=("saved_ms",))
    store = Store(stream.sparkSession, {"saved": saves, "decided": Kept("seq long, status string, retry_after_ms long")}, folder and f"{folder}/admission")
    window = max(user.window_ms, block.window_ms)

    def each(batch: DataFrame, n: int) -> None:
        new = batch.select("seq", "user_id", "client_id", "cell", "saved_ms").persist()
        old = store.read("saved", n)
        # The history is looked up by the batch's own readings, of which the smaller side decides the join.
        again = old.select("user_id", "client_id").join(new, ["user_id", "client_id"]).select("seq").distinct()
        dups = again.select("seq", F.lit("duplicate").alias("status"), F.lit(None).cast("long").alias("retry_after_ms"))
        open_rows = new.join(again, "seq", "left_anti")
        since = open_rows.agg(F.min("saved_ms")).first()[0] or 0
        recent = old.where(F.col("saved_ms") > since - window)  # reaches the scan, which skips what is sorted before it
        out = admit(open_rows.unionByName(recent), user, block).join(open_rows.select("seq"), "seq", "left_semi").unionByName(dups).checkpoint()
        store.commit(n, {"saved": new.join(out.where("status = 'admitted'"), "seq", "left_semi").select(old.columns), "decided": out})
        new.unpersist()

    run_to_end(stream, each, folder)
    return store.read("decided")


def retry_times(refused: DataFrame) -> DataFrame:
    """(user_id, retry_at_ms): a user's held-back readings wait for the longest of their times, and RETRY_MS at least."""
    wait = F.greatest(F.lit(RETRY_MS), F.max("retry_after_ms"))
    return refused.groupBy("user_id").agg((F.max("saved_ms") + wait).alias("retry_at_ms"))


def dedupe(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Retries within the delay drop, by arrival. Only for streams without a limiter: in front of one it would
    swallow the retries of readings that were held back."""
    return stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["user_id", "client_id"])


def session_frames(stream: DataFrame, gap: str = "3 seconds", delay: str = "10 seconds", frames: int = 240) -> DataFrame:
    """Closed sessions (device_id, start, end, n, laeq, lamax) of a stream of frames (device_id, ts, db_spl) that hold
    `frames` or more."""
    s = stream.withWatermark("ts", delay).groupBy("device_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("n"), ac.energy_avg("db_spl").alias("laeq"), F.max("db_spl").alias("lamax")).where(F.col("n") >= frames).select("device_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "laeq", "lamax")


def frame_windows(stream: DataFrame, delay: str = "1 second") -> DataFrame:
    """Tumbling windows of a frame's length over samples (session_id, ts, value): dbfs and the number of samples."""
    w = stream.withWatermark("ts", delay).groupBy("session_id", F.window("ts", "125 milliseconds").alias("w"))
    return w.agg(F.count("*").alias("n"), ac.dbfs_of(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("dbfs")).select("session_id", F.col("w.start").alias("start"), "n", "dbfs")


def busy_blocks(stream: DataFrame, least: int = BLOCK_LIMIT.count, length: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(cell, start, n): sliding windows in which a block gets `least` readings or more, by arrival."""
    w = stream.withWatermark("arrived", delay).groupBy("cell", F.window("arrived", length, slide).alias("w")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= least).select("cell", F.col("w.start").alias("start"), "n")


def collected(stream: DataFrame, schema: str, folder: str | None = None) -> DataFrame:
    """All that an append-mode stream gives over what is there now, as a table. With the same folder a later run goes on
    from there and adds to it."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    query: StreamingQuery = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
