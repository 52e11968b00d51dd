"""Admission with retries as keyed state: what is held back waits in the state, and timers bring it in again."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.readings import BLOCK_LIMIT, DAY_MS, USER_LIMIT, Limit
from .jobs import RETRY_MS

ATTEMPTS = "seq long, attempt int, at_ms long, status string, wait_ms long"
#: Readings that were told the same in the same turns, one after the other: the first attempts of each, the turns and their waits.
RUNS = "status string, seqs array<long>, attempts array<int>, at_ms array<long>, wait_ms array<long>"
_COLUMNS = [c.split()[0] for c in RUNS.split(", ")]
#: Of transformWithState; the default store can't hold several states of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Numbers that a key gives at once, the most turns and readings of a run, and the readings in one entry of the state.
BATCH, TURNS, READINGS, PACK = 100_000, 64, 4096, 10_000
#: A waiting reading.
WAITING = pa.schema([("due", pa.int64()), ("attempt", pa.int32()), ("seq", pa.int64()), ("user_id", pa.int64()), ("client_id", pa.int64()), ("cell", pa.string())])


def packed(columns: list) -> tuple[bytes]:
    """Waiting readings as one entry of the state, which takes and gives each entry by itself, at the cost of a call."""
    batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, WAITING, strict=True)], schema=WAITING)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def unpacked(entry: tuple[bytes]) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(entry[0])).read_all().columns), strict=True)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within have the store that keyed states need, and no more than two partitions of state for each core, as
    every one is a store and a worker of its own. The session's own settings come back after."""
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(few)}
    held = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


class Outbox(StatefulProcessor):
    """The readings of one key in order of time, refused ones again and again until they are admitted.

    State: `waiting`, packs of readings that haven't had their turn, new ones due when they were saved and held-back ones in their
    user's next round; `recent`, what was admitted within the longer window; `seen`, ids of admitted readings for
    `remember_ms`. A timer stands at the earliest turn; when the watermark has passed it, all turns up to the watermark
    are taken in order. So batches, kills and restarts don't change what is decided.
    """

    def __init__(self, user: Limit, block: Limit, remember_ms: int, retry_ms: int = RETRY_MS) -> None:
        self.user, self.block, self.remember_ms, self.retry_ms = user, block, remember_ms, retry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "readings binary")
        self.recent = handle.getListState("recent", "user_id long, cell string, at_ms long")
        self.seen = handle.getMapState("seen", "user_id long, client_id long", "at_ms long")
        self.forgot = handle.getValueState("forgot", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for p in rows:
            if len(p):
                self.waiting.appendValue(packed([p["saved_ms"], [0] * len(p), p["seq"], p["user_id"], p["client_id"], p["cell"]]))
                least = int(p["saved_ms"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [w for entry in self.waiting.get() for w in unpacked(entry)]
        due = any(w[0] <= now for w in waiting)
        turns = Turns(self, waiting, list(self.recent.get()), [k for k, _ in self.seen.iterator()] if due else [])
        for out in turns.runs(now):
            yield pd.DataFrame(dict(zip(_COLUMNS, (pd.Series(c, dtype=object) for c in zip(*out, strict=True)), strict=True)))
        left = turns.left()
        if due:
            packs = [packed(list(zip(*left[k : k + PACK], strict=True))) for k in range(0, len(left), PACK)]
            self.waiting.put(packs) if packs else self.waiting.clear()
            since = now - max(self.user.window_ms, self.block.window_ms)
            recent = [r for r in turns.recent if r[2] > since]
            self.recent.put(recent) if recent else self.recent.clear()
            self.forget(now)
        if left:
            self.handle.registerTimer(max(now + 1, min(w[0] for w in left)))

    def forget(self, now: int) -> None:
        """Drops ids behind `remember_ms`, once in that time."""
        last = self.forgot.get()
        if last is None or now - last[0] >= self.remember_ms:
            self.forgot.update((now,))
            for k in [k for k, v in self.seen.iterator() if v[0] <= now - self.remember_ms]:
                self.seen.removeKey(k)

    def close(self) -> None:
        pass


class Held:
    """What a user holds back, and its rounds since that changed, in each of which all of it was refused alike."""

    def __init__(self, due: int) -> None:
        self.due, self.rounds = due, 0
        #: (seq, client_id, cell, attempt of the next turn less the rounds by now); the one cell of all, or None.
        self.readings: list[tuple] = []
        self.cell: str | None = None
        #: Whether one of the user was admitted since it was looked at reading by reading, so that some may be duplicates.
        self.changed = False
        self.status, self.at, self.waits = "", [], []

    def add(self, seq: int, client: int, cell: str, attempt: int) -> None:
        self.cell = cell if not self.readings or cell == self.cell else None
        self.readings.append((seq, client, cell, attempt - self.rounds))


class Turns:
    """The turns of a key's readings up to a time. seen: ids of admitted readings, read once, as asking the state for each turn is a
    call to another process.

    A block that more readings ask for than it takes refuses a user's round whole, again and again. Such a round is one step,
    however much the user holds back, and rounds that follow each other are one run of attempts.
    """

    def __init__(self, box: Outbox, waiting: list[tuple], recent: list[tuple], seen: list[tuple]) -> None:
        self.box, self.recent = box, [tuple(r) for r in recent]
        self.new = deque(sorted((w for w in map(tuple, waiting) if w[1] == 0), key=lambda w: (w[0], w[2])))
        self.held: dict[int, Held] = {}
        #: Users by their round's time, and the times in order.
        self.due: dict[int, list[int]] = {}
        self.dues: list[int] = []
        for due, attempt, seq, user, client, cell in map(tuple, waiting):
            if attempt:
                self.hold(user, due, (seq, client, cell, attempt)).changed = True
        self.users: dict[int, deque] = defaultdict(deque)
        self.cells: dict[str, deque] = defaultdict(deque)
        for u, cell, at in sorted(self.recent, key=lambda r: r[2]):
            self.users[u].append(at)
            self.cells[cell].append(at)
        self.seen = {(int(u), int(c)) for u, c in seen}
        self.out: list[tuple] = []
        self.size = 0

    def left(self) -> list[tuple]:
        return [*self.new, *((h.due, base + h.rounds, seq, u, client, cell) for u, h in self.held.items() for seq, client, cell, base in h.readings)]

    def until(self, now: int) -> Iterator[list[tuple]]:
        """The attempts of runs, in batches."""
        for out in self.runs(now):
            yield [(seq, n + k, at, status, wait) for status, seqs, first, times, waits in out for k, (at, wait) in enumerate(zip(times, waits, strict=True)) for seq, n in zip(seqs, first, strict=True)]

    def runs(self, now: int) -> Iterator[list[tuple]]:
        """Takes turns and gives runs in batches; at equal times rounds go before new readings, rounds by user, readings by seq."""
        while True:
            if self.dues and self.dues[0] <= now and (not self.new or self.dues[0] <= self.new[0][0]):
                at = heapq.heappop(self.dues)
                #: What a cell's limit tells users without a time of their own, until one is admitted.
                told: dict = {}
                for user in sorted(self.due.pop(at)):
                    self.round(at, user, told)
                    if self.size >= BATCH:
                        yield self.taken()
            elif self.new and self.new[0][0] <= now:
                at, attempt, seq, user, client, cell = self.new.popleft()
                status, wait = self.turn(at, user, client, cell)
                self.give(status, [(seq, attempt)], [at], [wait])
                if wait is not None:
                    mine = self.held.get(user)
                    if mine:
                        self.end_run(mine)
                    self.hold(user, at + max(self.box.retry_ms, wait), (seq, client, cell, attempt + 1))
            else:
                break
            if self.size >= BATCH:
                yield self.taken()
        for mine in self.held.values():
            self.end_run(mine)
            if self.size >= BATCH:
                yield self.taken()
        if self.out:
            yield self.taken()

    def taken(self) -> list[tuple]:
        out, self.out, self.size = self.out, [], 0
        return out

    def give(self, status: str, readings: list[tuple[int, int]], at: list[int], waits: list[int | None]) -> None:
        """A run of readings (seq, first attempt), in parts if they are many."""
        for k in range(0, len(readings), READINGS):
            seqs, first = zip(*readings[k : k + READINGS], strict=True)
            self.out.append((status, seqs, first, at, waits))
            self.size += len(seqs) + len(at)

    def end_run(self, mine: Held) -> None:
        if mine.at:
            begun = mine.rounds - len(mine.at)
            self.give(mine.status, [(seq, base + begun) for seq, _, _, base in mine.readings], mine.at, mine.waits)
            mine.at, mine.waits = [], []

    def round(self, at: int, user: int, told: dict) -> None:
        """All that a user has held back, at once. What is refused waits for the longest of the refusals' times."""
        mine = self.held[user]
        if mine.changed or user in self.users or mine.cell not in told:
            full = None if mine.changed else self.full(at, user, mine.cell)
            if full is None:
                told.clear()
                return self.each(at, user)
            status, wait = full
            due = at + max(self.box.retry_ms, wait)
            users = self.at(due)
            if status == "held-block":
                told[mine.cell] = status, wait, due, users
        else:
            status, wait, due, users = told[mine.cell]
        if status != mine.status or len(mine.at) >= TURNS:
            self.end_run(mine)
            mine.status = status
        mine.at.append(at)
        mine.waits.append(wait)
        mine.rounds += 1
        mine.due = due
        users.append(user)

    def each(self, at: int, user: int) -> None:
        """A round reading by reading, by seq."""
        mine = self.held.pop(user)
        self.end_run(mine)
        told, refused, admitted = defaultdict(list), [], False
        for seq, client, cell, base in sorted(mine.readings):
            status, wait = self.turn(at, user, client, cell)
            told[status, wait].append((seq, base + mine.rounds))
            admitted |= status == "admitted"
            if wait is not None:
                refused.append((seq, client, cell, base + mine.rounds + 1, wait))
        for (status, wait), readings in told.items():
            self.give(status, readings, [at], [wait])
        if refused:
            due = at + max(self.box.retry_ms, *(r[-1] for r in refused))
            for r in refused:
                self.hold(user, due, r[:-1])
            self.held[user].changed = admitted

    def hold(self, user: int, due: int, reading: tuple) -> Held:
        """In the user's next round, which a first refusal sets."""
        mine = self.held.get(user)
        if mine is None:
            mine = self.held[user] = Held(due)
            self.at(due).append(user)
        mine.add(*reading)
        return mine

    def at(self, due: int) -> list[int]:
        """The users whose rounds are then."""
        if due not in self.due:
            self.due[due] = []
            heapq.heappush(self.dues, due)
        return self.due[due]

    def full(self, at: int, user: int, cell: str | None) -> tuple[str, int] | None:
        """The limit that refuses a user's reading in a cell at a time, and what it must wait."""
        for status, held, key, limit in (("held-user", self.users, user, self.box.user), ("held-block", self.cells, cell, self.box.block)):
            times = held.get(key)
            while times and times[0] <= at - limit.window_ms:
                times.popleft()
            if times and len(times) >= limit.count:
                return status, times[0] + limit.window_ms - at
            if times is not None and not times:
                del held[key]
        return None

    def turn(self, at: int, user: int, client: int, cell: str) -> tuple[str, int | None]:
        """Decides a reading at a time: its status, and what it must wait if it is refused."""
        if (user, client) in self.seen:
            return "duplicate", None
        told = self.full(at, user, cell)
        if told is None:
            self.seen.add((user, client))
            self.box.seen.updateValue((user, client), (at,))
            self.recent.append((user, cell, at))
            self.users[user].append(at)
            self.cells[cell].append(at)
            if user in self.held:
                self.held[user].changed = True
        return told or ("admitted", None)


def attempts(runs: DataFrame) -> DataFrame:
    """Every attempt (seq, attempt, at_ms, status, wait_ms) of runs. Works on streams too."""
    each = runs.select("status", "at_ms", "wait_ms", F.explode(F.arrays_zip("seqs", "attempts")).alias("r"))
    each = each.select("r.*", "status", F.posexplode(F.arrays_zip("at_ms", "wait_ms")).alias("k", "t"))
    return each.select(F.col("seqs").alias("seq"), (F.col("attempts") + F.col("k")).alias("attempt"), "t.at_ms", "status", "t.wait_ms")


def runs_of_attempts(stream: DataFrame, key: str = "cell", user: Limit = USER_LIMIT, block: Limit = BLOCK_LIMIT, delay: str = "10 seconds", remember_ms: int = 30 * DAY_MS) -> DataFrame:
    """Every attempt, as RUNS, of a stream of readings (seq, user_id, client_id, cell,
    saved_ms): admitted, duplicate, held-user or held-block. A held-back reading comes in again, with all others that its
    user has held back in the key, after RETRY_MS or the longest of their waits, until it is admitted.

    Both limits are counted within the key, so they are exact where a key has all readings of its users and blocks: the block,
    where users keep to one, or an area or group that they don't leave. Elsewhere admit_stream decides. delay: how far
    saved_ms may be out of order between batches; rows at or behind the watermark of earlier batches are dropped by Spark. What is
    due after the watermark waits in the state for the next batch or run. A retry is known as a duplicate for remember_ms.
    The query must be started within state_store(). Rows with a null are left out.
    """
    rows = stream.select(F.col(key).cast("string").alias("hg_key"), F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("long").alias(c) for c in ("user_id", "client_id")), "cell", F.col("saved_ms").cast("long").alias("saved_ms"))
    rows = rows.dropna().withColumn("hg_at", F.timestamp_millis("saved_ms")).withWatermark("hg_at", delay)
    return rows.groupBy("hg_key").transformWithStateInPandas(Outbox(user, block, remember_ms), RUNS, "append", "EventTime")


def admit_with_retries(stream: DataFrame, key: str = "cell", user: Limit = USER_LIMIT, block: Limit = BLOCK_LIMIT, delay: str = "10 seconds", remember_ms: int = 30 * DAY_MS) -> DataFrame:
    """runs_of_attempts, a row for each attempt. Where blocks are crowded these are many times the runs, so a table is better kept as
    runs and read by attempts()."""
    return attempts(runs_of_attempts(stream, key, user, block, delay, remember_ms))
