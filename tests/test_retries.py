"""Retries as keyed state: against one loop over all events, over batches, kills and restarts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hushgrid.operators import readings as rd
from hushgrid.streaming import jobs, retries

SCHEMA = "seq long, user_id long, client_id long, cell string, saved_ms long"
USER, BLOCK = rd.Limit(3, 900_000), rd.Limit(4, 600_000)


def made(n, seed, users=6, cells=2):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(0, 3_600_000) // 1000 * 1000 for _ in range(n))
    return [(k, (u := rnd.randrange(users)), rnd.randrange(25), f"c{u % cells}", t) for k, t in enumerate(times)]


def loop(rows, until):
    """Time goes on from event to event; nothing is kept by key."""
    saved, done, held, rounds, out = [], set(), {}, {}, []
    rows = sorted((t, q, u, c, cell) for q, u, c, cell, t in rows)

    def turn(at, q, u, c, cell, n):
        if (u, c) in done:
            return out.append((q, n, at, "duplicate", None))
        for name, limit, mine in (("held-user", USER, [t for t, v, _ in saved if v == u]), ("held-block", BLOCK, [t for t, _, x in saved if x == cell])):
            near = [t for t in mine if t > at - limit.window_ms]
            if len(near) >= limit.count:
                wait = near[0] + limit.window_ms - at
                out.append((q, n, at, name, wait))
                return wait
        saved.append((at, u, cell))
        done.add((u, c))
        out.append((q, n, at, "admitted", None))

    while True:
        due = min(((t, u) for u, t in rounds.items()), default=None)
        if due and due[0] <= until and (not rows or due[0] <= rows[0][0]):
            at, user = due
            del rounds[user]
            mine, waits = sorted(held.pop(user)), []
            for q, n, c, cell in mine:
                wait = turn(at, q, user, c, cell, n)
                if wait is not None:
                    waits.append(wait)
                    held.setdefault(user, []).append((q, n + 1, c, cell))
            if waits:
                rounds[user] = at + max(60_000, *waits)
        elif rows and rows[0][0] <= until:
            at, q, u, c, cell = rows.pop(0)
            wait = turn(at, q, u, c, cell, 0)
            if wait is not None:
                held.setdefault(u, []).append((q, 1, c, cell))
                rounds.setdefault(u, at + max(60_000, wait))
        else:
            return sorted(out, key=str)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_readings_come_in_again(spark, tmp_path):
    rows = made(160, 1)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", status string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with retries.state_store(spark):
        got = collect(jobs.collected(retries.admit_with_retries(stream, "cell", USER, BLOCK, "0 seconds"), retries.ATTEMPTS))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = loop(rows, rows[-1][4])
    assert got == want
    again = [r for r in want if r[1] and r[3] == "admitted"]
    assert len(again) > 20 and {r[3] for r in want} == {"admitted", "duplicate", "held-user", "held-block"}


def test_kill_and_restart_between_timers(spark, tmp_path):
    """Three files batch by batch; a batch with timers dies before its output is written; a later run goes on, with a new
    file. The attempts are those of one run over everything."""
    rows = made(200, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = [0, 50, 100, 150, 200]
    add = lambda k: df.where(f"seq >= {cut[k]} AND seq < {cut[k + 1]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(0), add(1), add(2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, fails = str(tmp_path / "out"), [2]

    def run():
        def each(batch, n):
            if n in fails:
                batch.count()  # the state is made, but the batch isn't done
                fails.remove(n)
                raise RuntimeError("killed")
            batch.write.mode("overwrite").parquet(f"{out}/{n}")

        with retries.state_store(spark):
            jobs.run_to_end(retries.admit_with_retries(stream, "cell", USER, BLOCK, "0 seconds"), each, str(tmp_path / "at"))

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    part = spark.read.schema(retries.ATTEMPTS).parquet(f"{out}/*")
    assert not fails and collect(part) == loop(rows[:150], rows[149][4])
    add(3)
    run()
    assert collect(spark.read.schema(retries.ATTEMPTS).parquet(f"{out}/*")) == loop(rows, rows[-1][4])


def test_ids_are_forgotten(spark, tmp_path):
    """A retry within the time is a duplicate, one long after it is a reading of its own; nulls are left out."""
    day = 86_400_000
    rows = [(0, 1, 1, "a", day), (1, 1, 1, "a", day + 9), (2, 2, 2, "a", 4 * day), (3, 2, 2, "a", 4 * day + 1), (4, 1, 1, "a", 6 * day), (5, None, 1, "a", 7 * day), (6, 1, 1, None, 7 * day), (7, 9, 9, "b", 7 * day)]
    for k, some in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with retries.state_store(spark):
        got = jobs.collected(retries.admit_with_retries(stream, "cell", delay="0 seconds", remember_ms=day).select("seq", "status"), "seq long, status string")
    assert {r.seq: r.status for r in got.collect()} == {0: "admitted", 1: "duplicate", 2: "admitted", 3: "duplicate", 4: "admitted", 7: "admitted"}
    empty = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).where(F.lit(False))
    with retries.state_store(spark):
        assert jobs.collected(retries.admit_with_retries(empty), retries.ATTEMPTS).count() == 0


def test_turns_read_the_state_once_and_come_in_batches(monkeypatch):
    """Attempts of a crowded key, as by one loop; the state is asked for no single turn."""

    class Seen:
        def updateValue(self, key, value):  # noqa: N802
            pass

    class Box:
        user, block, retry_ms, seen = USER, BLOCK, 60_000, Seen()

    monkeypatch.setattr(retries, "BATCH", 50)
    rows = [r for r in made(400, 5) if r[3] == "c0"]
    turns = retries.Turns(Box(), [(t, 0, q, u, c, cell) for q, u, c, cell, t in rows], [], [])
    parts = list(turns.until(3_600_000))
    assert len(parts) > 5 and sorted((a for p in parts for a in p), key=str) == loop(rows, 3_600_000)


def test_rounds_of_a_crowded_block_are_runs(spark, tmp_path, monkeypatch):
    """What a user holds back is refused whole, again and again: few numbers say many attempts, in parts of any size, and spread
    they are those of one loop."""

    class Seen:
        def updateValue(self, key, value):  # noqa: N802
            pass

    class Box:
        user, block, retry_ms, seen = USER, rd.Limit(1, 600_000), 1_000, Seen()

    rows = [(k, k % 5, k, "c0", 1000 * (k // 2)) for k in range(120)]
    waiting = [(t, 0, q, u, c, cell) for q, u, c, cell, t in rows]
    runs = [r for part in retries.Turns(Box(), waiting, [], []).runs(36_000_000) for r in part]
    assert 2 * sum(len(r[1]) + len(r[3]) for r in runs) < sum(len(r[1]) * len(r[3]) for r in runs)
    monkeypatch.setattr(retries, "TURNS", 3)
    monkeypatch.setattr(retries, "READINGS", 7)
    spread = sorted((a for part in retries.Turns(Box(), waiting, [], []).until(36_000_000) for a in part), key=str)
    assert spread == sorted(((q, n + k, at, s, w) for s, seqs, first, times, waits in runs for q, n in zip(seqs, first) for k, (at, w) in enumerate(zip(times, waits))), key=str)
    df = spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in runs], retries.RUNS)
    assert collect(retries.attempts(df)) == spread
    left = [(5, 1, 2, 3, 4, "ä"), (6, 0, 2**62, -3, 4, "b")]
    assert list(retries.unpacked(retries.packed(list(zip(*left))))) == left
    made_rows = made(160, 7)
    spark.createDataFrame(made_rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "in"))
    with retries.state_store(spark):
        kept = jobs.collected(retries.runs_of_attempts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "cell", USER, BLOCK, "0 seconds"), retries.RUNS)
    assert collect(retries.attempts(kept)) == loop(made_rows, made_rows[-1][4])
