"""Tables that many batches write: levels, one commit for several tables, kills, and what a batch costs."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from hushgrid.operators import readings as rd
from hushgrid.streaming import jobs, store

TABLES = {"rows": store.Kept("k string, n long"), "sums": store.Kept("k string, energy double, count long", jobs.summed(["k"]))}


def batch(spark, n):
    """Two rows, and their sums; every third batch takes back what the one before it added to k0."""
    rows = spark.createDataFrame([("k0", n), (f"k{n % 5}", n)], "k string, n long").coalesce(1)
    back = n % 3 == 2
    sums = spark.createDataFrame([("k0", -1.0 if back else 1.0, -1 if back else 1), (f"k{n % 5}", float(n), 1)], "k string, energy double, count long").coalesce(1)
    return {"rows": rows, "sums": sums}


def expected(last):
    rows = sorted([("k0", n) for n in range(last)] + [(f"k{n % 5}", n) for n in range(last)])
    sums = {}
    for n in range(last):
        for k, e, c in (("k0", *((-1, -1) if n % 3 == 2 else (1, 1))), (f"k{n % 5}", n, 1)):
            sums[k] = [sums.get(k, [0, 0])[0] + e, sums.get(k, [0, 0])[1] + c]
    return rows, {k: tuple(v) for k, v in sums.items() if v[1] > 0}


def found(s, before=None):
    return sorted((r.k, r.n) for r in s.read("rows", before).collect()), {r.k: (r.energy, r["count"]) for r in s.read("sums", before).collect()}


def test_levels(spark, tmp_path, monkeypatch):
    """After each batch as one loop has it; segments, files and calls grow with the logarithm of the batches."""
    monkeypatch.setattr(store, "FAN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    s = store.Store(spark, TABLES, str(tmp_path / "s"))
    calls = []
    try:
        for n in range(30):
            before, s.calls = s.calls, 0
            s.commit(n, batch(spark, n))
            calls.append(s.calls)
            live = s.segments()
            assert all(len(x) <= 2 * 4 for x in live.values())  # under FAN for each of the levels 0 to 3
            if n in (0, 2, 8, 17, 26, 29):
                assert found(s) == expected(n + 1)
                assert found(s, n) == expected(n)  # what a second run of the batch would begin with
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [level for level, _ in s.segments()["rows"]] == [3, 1]  # 27 and 3 batches
    assert len(os.listdir(tmp_path / "s/manifests")) <= 2 * (store.KEPT + 1)  # with checksum files
    kept = {d for d in os.listdir(tmp_path / "s/rows")}
    assert len(kept) <= 8
    # A batch's calls: some for its commit, and one for each segment that goes.
    assert max(calls) <= 40 and sum(calls[15:]) / 15 < 25


@pytest.mark.parametrize("where", ["segment", "compaction", "manifest", "published", "clean"])
def test_killed_batch_runs_again(spark, tmp_path, monkeypatch, where):
    """Batch 8 makes segments of the levels 1 and 2; it dies in the middle and runs again, in a new process."""
    monkeypatch.setattr(store, "FAN", 3)
    at = str(tmp_path / "s")
    for n in range(8):
        store.Store(spark, TABLES, at).commit(n, batch(spark, n))
    write, publish, clean = store.Store._write, store.Store._publish, store.Store._clean

    def killed(*_):
        raise RuntimeError("killed")

    def write_until(self, rows, name, segment):
        if segment == {"segment": "sums/8.0", "compaction": "sums/8.2"}.get(where):
            if where == "compaction":
                os.makedirs(f"{at}/{segment}")  # half-written
            killed()
        write(self, rows, name, segment)

    def publish_and_die(self, batch, now):
        publish(self, batch, now)
        killed()

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_write", write_until)
        if where == "manifest":
            m.setattr(store.Store, "_publish", killed)
        if where == "published":
            m.setattr(store.Store, "_publish", publish_and_die)
        if where == "clean":
            m.setattr(store.Store, "_clean", killed)
        with pytest.raises(RuntimeError, match="killed"):
            store.Store(spark, TABLES, at).commit(8, batch(spark, 8))
    s = store.Store(spark, TABLES, at)
    assert found(s) == expected(9 if where in ("published", "clean") else 8)
    s.commit(8, batch(spark, 8))
    assert found(s) == expected(9) and [level for level, _ in s.segments()["sums"]] == [2]
    for n in range(9, 12):
        s.commit(n, batch(spark, n))
    assert found(s) == expected(12)


SCHEMA = "seq long, user_id long, client_id long, cell string, saved_ms long, laeq double, osm_id string, hour int"


def readings(spark, path, n=60, files=4):
    rnd = random.Random(9)
    rows = [(k, rnd.randrange(5), k, f"c{rnd.randrange(3)}", 1000 * k, 50.0 + k % 20, f"node/{rnd.randrange(3)}", rnd.randrange(24)) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(files):
        df.where(f"seq % {files} = {k}").coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_venue_hours_with_each_reading(spark, tmp_path, monkeypatch):
    """Cells and venue hours of a stream that is killed between its tables equal those of the batch jobs."""
    df, stream = readings(spark, str(tmp_path / "in"))
    searches = spark.createDataFrame([("c0", 5000, [("node/0",), ("node/1",)]), ("c1", 1, [("node/2",)]), ("c0", 30_000, [("node/1",)])], "cell string, fetched_ms long, venues array<struct<osm_id string>>")
    write, fails = store.Store._write, [True]

    def dying(self, rows, name, segment):
        if segment == "hours/1.0" and fails:
            fails.clear()
            raise RuntimeError("killed")
        write(self, rows, name, segment)

    monkeypatch.setattr(store.Store, "_write", dying)
    with pytest.raises(Exception, match="killed"):
        jobs.rollup_visits(stream, searches, str(tmp_path / "at"))
    cells, hours = jobs.rollup_visits(stream, searches, str(tmp_path / "at"))
    pick = lambda d, *keys: {tuple(r[k] for k in keys): (r["count"], round(r.energy, 3)) for r in d.collect()}
    assert pick(cells, "cell") == pick(rd.cell_rollup(df), "cell")
    want = pick(rd.venue_hours(rd.attach_visits(df, searches)), "venue_id", "hour")
    assert pick(hours, "venue_id", "hour") == want and want


def test_refused_readings_are_kept(spark, tmp_path, monkeypatch):
    """Accepted and refused together are the input, each row once, also after a kill before the commit."""
    df, _ = readings(spark, str(tmp_path / "x"), 40, 1)
    good = df.withColumns({"at_ms": F.col("saved_ms") + F.when(F.col("seq") % 7 == 0, 600_000).otherwise(0), "duration_sec": F.when(F.col("seq") % 5 == 0, 3.0).otherwise(30.0), "lamax": F.col("laeq"), "l10": F.col("laeq"), "l90": F.col("laeq"), "model": F.lit("m"), "offset_db": F.lit(120.0), "cell": F.lit("8a2830828747fff")})
    for k in range(3):
        good.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(good.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    publish, fails = store.Store._publish, [True]

    def dying(self, batch, now):
        if batch == 1 and fails:
            fails.clear()
            raise RuntimeError("killed")
        publish(self, batch, now)

    monkeypatch.setattr(store.Store, "_publish", dying)
    with pytest.raises(Exception, match="killed"):
        jobs.split_stream(stream, str(tmp_path / "at"))
    accepted, refused = jobs.split_stream(stream, str(tmp_path / "at"))
    got = {r.seq: None for r in accepted.collect()} | {r.seq: r.reason for r in refused.collect()}
    assert got == {k: "time" if k % 7 == 0 else "duration" if k % 5 == 0 else None for k in range(40)}
    assert accepted.count() + refused.count() == 40 and accepted.columns == good.columns
