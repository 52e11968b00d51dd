"""Readings of sound levels: validation, retries, rate limits, visits, rollups and removals."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import acoustics as ac, cells as ce
from ..plans.components import connected_components
from ..plans.shared import stored

#: Seconds of a session, minutes that a phone's clock may be ahead, bounds of levels, offsets and model names.
SESSION_SECONDS, CLOCK_SKEW_MS = 30.0, 5 * 60_000
LEVELS, OFFSETS, MODEL_LENGTH = (0.0, 140.0), (80.0, 160.0), 100
DAY_MS = 86_400_000
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class Limit:
    """At most `count` saved rows in any trailing window, which is open at its old end."""

    count: int
    window_ms: int = HOUR_MS


USER_LIMIT, BLOCK_LIMIT, SEARCH_LIMIT = Limit(120), Limit(30), Limit(6, 60_000)


def rejection_reason(now_ms: Column | str = "saved_ms") -> Column:
    """The first rule that a reading fails, or null. Columns: cell, at_ms, duration_sec, laeq, lamax, l10, l90,
    model, offset_db. Nulls fail the rule that needs the value."""
    now = F.col(now_ms) if isinstance(now_ms, str) else now_ms
    sound = lambda c: ac.is_finite(c) & F.col(c).between(*LEVELS)
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = [
        ("cell", ce.is_block("cell")),
        ("time", F.col("at_ms").isNotNull() & (F.col("at_ms") <= now + CLOCK_SKEW_MS)),
        ("duration", F.col("duration_sec") == SESSION_SECONDS),
        ("level", sound("laeq") & sound("lamax") & sound("l10") & sound("l90")),
        ("order", (F.col("l90") <= F.col("l10")) & (F.col("l10") <= F.col("lamax")) & (F.col("laeq") <= F.col("lamax"))),
        ("model", F.length("model").between(1, MODEL_LENGTH)),
        ("offset", ac.is_finite("offset_db") & F.col("offset_db").between(*OFFSETS)),
    ]
    return F.coalesce(*(F.when(no(ok), F.lit(name)) for name, ok in rules))


def valid_visit(osm_id: Column | str = "osm_id", hour: Column | str = "hour") -> Column:
    i, h = (F.col(x) if isinstance(x, str) else x for x in (osm_id, hour))
    return F.coalesce(i.rlike(r"^(node|way|relation)/\d+$") & (h == F.floor(h)) & h.between(0, 23), F.lit(False))


def first_saved(readings: DataFrame) -> DataFrame:
    """Of each (user_id, client_id) the row saved first; ties go to the smaller seq."""
    w = Window.partitionBy("user_id", "client_id").orderBy("saved_ms", "seq")
    return readings.withColumn("attempt", F.row_number().over(w)).where("attempt = 1").drop("attempt")


def unseen(readings: DataFrame, history: DataFrame) -> DataFrame:
    return readings.join(history.select("user_id", "client_id"), ["user_id", "client_id"], "left_anti")


def with_arrivals(rows: DataFrame, name: str, key: str, window_ms: int) -> DataFrame:
    """rows with `name`: how many rows of the key arrived in the trailing window before; equal times are ordered by seq.

    A key's time is cut into slots of a window's length, and a row is also filed under the slot after its own, so a task
    gets two windows of a busy key and not all of its time.
    """
    slot = F.floor(F.col("saved_ms") / window_ms)
    each = rows.withColumn("hg_slot", F.explode(F.array(slot, slot + 1)))
    w = Window.partitionBy(key, "hg_slot").orderBy("saved_ms").rangeBetween(-(window_ms - 1), 0)
    peers = Window.partitionBy(key, "hg_slot", "saved_ms").orderBy(F.desc("seq"))
    return each.withColumn(name, F.count("*").over(w) - F.row_number().over(peers)).where(F.col("hg_slot") == slot).drop("hg_slot")


#: Windows of time that a slot of a key has.
SLOT_WINDOWS = 8


def with_full(rows: DataFrame, name: str, key: str, limit: Limit) -> DataFrame:
    """rows with `name`: whether `limit.count` rows of the key or more arrived in the trailing window before, equal times
    ordered by seq; then the one that came `limit.count` rows before is within the window.

    A key's time is cut into slots of some windows, and the rows of a slot's last window are also filed under the next, so a
    task gets those windows of a busy key and not all of its time.
    """
    span = SLOT_WINDOWS * limit.window_ms
    slot = F.floor(F.col("saved_ms") / span)
    late = F.col("saved_ms") >= (slot + 1) * span - limit.window_ms
    each = rows.where("saved_ms IS NOT NULL").withColumn("hg_slot", F.explode(F.when(late, F.array(slot, slot + 1)).otherwise(F.array(slot))))
    w = Window.partitionBy(key, "hg_slot").orderBy("saved_ms", "seq")
    full = F.lag("saved_ms", limit.count).over(w) > F.col("saved_ms") - limit.window_ms
    return each.withColumn(name, F.coalesce(full, F.lit(False))).where(F.col("hg_slot") == slot).drop("hg_slot")


ADMITTED = "seq long, status string, retry_after_ms long"
#: Rows of one group that one task decides in order, and those of several small groups that go to a task together.
SLICE, LOT = 1_000_000, 100_000
_STATUS = np.array(["admitted", "duplicate", "refused-user", "refused-block"], dtype=object)
#: Rows whose values are Python's at a time.
_STEP = 50_000


def _one_by_one(rows: pd.DataFrame, user: Limit, block: Limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: the places of the asked ones, their status as a place in _STATUS, and what the refused ones wait. The
    others are what is known: times saved of a user or a block, and ids admitted before (role done)."""
    role = rows["role"].to_numpy()
    role = np.select([role == "asked", role == "known-user", role == "known-cell"], [0, 1, 2], 3)
    u, c = (pd.factorize(rows[k], use_na_sentinel=False)[0] for k in ("user_id", "cell"))
    client, found = pd.factorize(rows["client_id"])  # -1 is no id, so never seen before
    ids = np.where(client < 0, -1, pd.factorize(u * max(1, len(found)) + client)[0])
    held_user: list[list[int]] = [[] for _ in range(u.max(initial=-1) + 1)]
    held_cell: list[list[int]] = [[] for _ in range(c.max(initial=-1) + 1)]
    done = bytearray(ids.max(initial=-1) + 1)
    times, status, wait = rows["saved_ms"].to_numpy(), np.zeros(len(rows), np.int8), np.zeros(len(rows), np.int64)
    for a in range(0, len(rows), _STEP):
        part = slice(a, a + _STEP)
        for k, (r, who, where, i, t) in enumerate(zip(*(x[part].tolist() for x in (role, u, c, ids, times)), strict=True), a):
            if r == 3:
                if i >= 0:
                    done[i] = 1
                continue
            if r:
                (held_user[who] if r == 1 else held_cell[where]).append(t)
                continue
            if i >= 0 and done[i]:
                status[k] = 1
                continue
            mine = held_user[who]
            if mine and mine[0] <= t - user.window_ms:
                del mine[: bisect_right(mine, t - user.window_ms)]
            if len(mine) >= user.count:
                status[k], wait[k] = 2, mine[0] + user.window_ms - t
                continue
            near = held_cell[where]
            if near and near[0] <= t - block.window_ms:
                del near[: bisect_right(near, t - block.window_ms)]
            if len(near) >= block.count:
                status[k], wait[k] = 3, near[0] + block.window_ms - t
                continue
            if i >= 0:
                done[i] = 1
            mine.append(t)
            near.append(t)
    asked = np.flatnonzero(role == 0)
    return asked, status[asked], wait[asked]


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.iloc[np.lexsort((rows["seq"].to_numpy(), rows["saved_ms"].to_numpy()))]


def _answer(asked: pd.DataFrame, status: np.ndarray, wait: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"seq": asked["seq"].to_numpy(), "status": _STATUS[status], "retry_after_ms": pd.arrays.IntegerArray(wait, status < 2)})


_HANDED = "grp long, slice int, user_id long, client_id long, cell string, saved_ms long"
_ENTRY = "slice int, role string, user_id long, client_id long, cell string, saved_ms long"


def _wanted(cut: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What slices ask for: (grp, user_id, slice, first), (grp, cell, slice, first), first being when the slice begins; and
    (user_id, client_id, slice) of the ids that more than one slice has."""
    asked = cut.where("role = 'asked'")
    first = cut.groupBy("grp", "slice").agg(F.min("saved_ms").alias("first"))
    ids = asked.groupBy("user_id", "client_id").agg(F.collect_set("slice").alias("slices")).where("size(slices) > 1")
    of = [stored(asked.select("grp", key, "slice").distinct().join(first, ["grp", "slice"])) for key in ("user_id", "cell")]
    return of[0], of[1], stored(ids.select("user_id", "client_id", F.explode("slices").alias("slice")))


def _entries(cut: DataFrame, wanted: tuple[DataFrame, DataFrame, DataFrame], new: DataFrame, user: Limit, block: Limit) -> DataFrame:
    """(slice, role, user_id, client_id, cell, saved_ms): what earlier slices hand on, given what they admit. Of a user or a
    block that a slice asks for, the times saved within a window before the slice, which the limit bounds; and those of
    its own readings that were admitted before. What a role doesn't need is 0 or empty."""
    parts = []
    for role, key, limit, wants in (("known-user", "user_id", user, wanted[0]), ("known-cell", "cell", block, wanted[1])):
        given = new.unionByName(cut.where(F.col("role") == role).select(*new.columns)).select("grp", key, F.col("slice").alias("of"), "saved_ms")
        parts.append(given.join(wants, ["grp", key]).where((F.col("of") < F.col("slice")) & (F.col("saved_ms") > F.col("first") - limit.window_ms)).select("slice", F.lit(role).alias("role"), key, "saved_ms"))
    before = new.select("user_id", "client_id", F.col("slice").alias("of")).join(wanted[2], ["user_id", "client_id"]).where("of < slice")
    parts.append(before.select("slice", F.lit("done").alias("role"), "user_id", "client_id").distinct())
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select("slice", "role", "user_id", "client_id", "cell", "saved_ms").fillna(0, ["user_id", "client_id", "saved_ms"]).fillna("", ["cell"])


def _long_groups(rows: DataFrame, n: int, user: Limit, block: Limit) -> DataFrame:
    """decided_in_slices of groups that no task can hold, in n slices."""
    cut = stored(rows.repartitionByRange(n, "grp", "saved_ms", "seq").withColumn("slice", F.spark_partition_id()))
    wanted = _wanted(cut)

    def run(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        rows, begin = _in_order(rows), entry.sort_values("saved_ms", kind="stable")
        used = ["role", "user_id", "client_id", "cell", "saved_ms"]
        at, status, wait = _one_by_one(pd.concat([begin[used], rows[used]]) if len(begin) else rows, user, block)
        return rows.iloc[at - len(begin)], status, wait

    def hand_on(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        asked, status, _ = run(key, rows, entry)
        return asked.loc[status == 0, ["grp", "slice", "user_id", "client_id", "cell", "saved_ms"]]

    def answer(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return _answer(*run(key, rows, entry))

    def each(some: DataFrame, entry: DataFrame, f, schema: str) -> DataFrame:
        return some.repartition(n, "slice").groupBy("slice").cogroup(entry.groupBy("slice")).applyInPandas(f, schema)

    entry = cut.sparkSession.createDataFrame([], _ENTRY)
    new = stored(each(cut, entry, hand_on, _HANDED))
    begun: dict[int, tuple] = {}
    while True:
        entry = stored(_entries(cut, wanted, new, user, block))
        mark = F.xxhash64("role", "user_id", "client_id", "cell", "saved_ms")
        marks = {r[0]: tuple(r[1:]) for r in entry.groupBy("slice").agg(F.count("*"), F.bit_xor(mark), F.bit_xor(F.xxhash64(mark, "saved_ms", "role"))).collect()}
        changed = [s for s in marks.keys() | begun.keys() if marks.get(s) != begun.get(s)]
        if not changed:
            return each(cut, entry, answer, ADMITTED)
        again = F.col("slice").isin(changed)
        new, begun = stored(new.where(~again).unionByName(each(cut.where(again), entry.where(again), hand_on, _HANDED))), marks


def decided_in_slices(group: DataFrame, user: Limit, block: Limit, rows_a_slice: int | None = None) -> DataFrame:
    """(seq, status, retry_after_ms) of the asked rows of closed groups: grp, seq, user_id, client_id, cell, saved_ms, and
    role: asked, known-user or known-cell.

    A group of no more rows than a slice is decided whole, small ones several in a task, so nothing is handed on. Longer
    groups are laid end to end, each in order of time, and cut into slices of equal size. All slices run at once, as
    if nothing had been saved before them; from what they admit follows what each should have begun with, and those that
    began otherwise run again, until no entry changes. After n rounds the first n slices of each group are right for
    certain, so it ends; mostly it ends sooner, as an entry reaches back a window only. A slice's entry is
    bounded by its rows and the limits; a round writes only what is admitted, and a count and a hash of each slice reach the
    driver.
    """
    size = rows_a_slice or SLICE
    held = stored(group)
    sizes = held.groupBy("grp").count()
    short, long = sizes.agg(*(F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)) for c in (F.col("count") <= size, F.col("count") > size))).first()
    lots = max(1, -(-short // LOT))
    alone = F.broadcast(sizes.where(F.col("count") > min(LOT, size)))  # at most a group for each lot of rows
    rows = held.join(alone, "grp", "left")
    few = rows.where(F.coalesce("count", F.lit(0)) <= size).withColumn("lot", F.when(F.col("count").isNull(), F.pmod(F.xxhash64("grp"), F.lit(lots))).otherwise(F.col("grp")))

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        p = _in_order(p)
        at, status, wait = _one_by_one(p, user, block)
        return _answer(p.iloc[at], status, wait)

    out = few.drop("count").repartition(lots, "lot").groupBy("lot").applyInPandas(whole, ADMITTED)
    if not long:
        return out
    return out.unionByName(_long_groups(rows.where(F.col("count") > size).drop("count"), -(-long // size), user, block))


def admit(readings: DataFrame, user: Limit = USER_LIMIT, block: Limit = BLOCK_LIMIT) -> DataFrame:
    """(seq, status, retry_after_ms): admitted, duplicate, refused-user or refused-block, as if the rows had been
    handled one by one in order of (saved_ms, seq). seq is unique.

    What was saved never exceeds what arrived, so a row with fewer arrivals than both limits before it is surely
    admitted, and a later attempt of such a reading surely a duplicate. Only the rest is contested. Contested rows
    that share a user or a block, however indirectly, are one group, with the sure admissions of their users and blocks;
    a group is decided in slices of time.
    """
    rows = readings.select("seq", F.col("user_id").cast("long").alias("user_id"), F.col("client_id").cast("long").alias("client_id"), "cell", "saved_ms")
    flagged = with_full(with_full(rows, "full_user", "user_id", user), "full_cell", "cell", block)
    tries = Window.partitionBy("user_id", "client_id").orderBy("saved_ms", "seq")
    every = tries.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flagged = stored(flagged.select("*", F.max(F.col("full_user") | F.col("full_cell")).over(every).alias("contested"), F.row_number().over(tries).alias("attempt")).drop("full_user", "full_cell"))
    sure = flagged.where("NOT contested")
    open_rows = flagged.where("contested").withColumns({"u": F.xxhash64(F.lit("user"), F.col("user_id").cast("string")), "c": F.xxhash64(F.lit("cell"), "cell")})
    groups = connected_components(open_rows.select(F.col("u").alias("a"), F.col("c").alias("b")))
    of_user = open_rows.select("user_id", "u").distinct().join(groups, F.col("u") == groups.node).select("user_id", F.col("component").alias("grp"))
    of_cell = open_rows.select("cell", "c").distinct().join(groups, F.col("c") == groups.node).select("cell", F.col("component").alias("grp"))
    known = sure.where("attempt = 1").select("seq", "user_id", "client_id", "cell", "saved_ms")
    group = (
        open_rows.select("seq", "user_id", "client_id", "cell", "saved_ms").join(of_user, "user_id").withColumn("role", F.lit("asked"))
        .unionByName(known.join(of_user, "user_id").withColumn("role", F.lit("known-user")))
        .unionByName(known.join(of_cell, "cell").withColumn("role", F.lit("known-cell")))
    )
    easy = sure.select("seq", F.when(F.col("attempt") == 1, "admitted").otherwise("duplicate").alias("status"), F.lit(None).cast("long").alias("retry_after_ms"))
    return easy.unionByName(decided_in_slices(group, user, block))


#: Searches that one task decides in order, two numbers each.
SEARCH_SLICE = 1_000_000


def _let_through(times: np.ndarray, entry: list[int], limit: Limit) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Of sorted times, after some let through before them: the stretches (from, to, until when) that are refused, and the last
    times let through that the limit still counts. From a refusal on it goes on with the first search late enough."""
    held, refused, k = deque(entry), [], 0
    while k < len(times):
        at = int(times[k])
        while held and held[0] <= at - limit.window_ms:
            held.popleft()
        if len(held) < limit.count:
            held.append(at)
            k += 1
            continue
        until = held[0] + limit.window_ms
        to = int(np.searchsorted(times, until))
        refused.append((k, to, until))
        k = to
    return refused, [t for t in held if not len(times) or t > times[-1] - limit.window_ms]


def search_budget(searches: DataFrame, limit: Limit = SEARCH_LIMIT, rows_a_slice: int | None = None) -> DataFrame:
    """(seq, status, retry_after_ms) of venue searches (seq, saved_ms) under one limit for all of them. A search without a time
    is left out.

    Searches are cut by time into slices. What a slice hands on is at most `limit.count` times. All slices run at once, as
    if nothing came before; then those that began otherwise than the one before them ends run again, until none did, which is
    after as many rounds as there are slices at most. A round brings the driver only those times, and writes nothing.
    """
    if limit.count < 1:
        raise ValueError("a limit lets at least one search through")
    rows = stored(searches.select("seq", F.col("saved_ms").cast("long").alias("saved_ms")).where("saved_ms IS NOT NULL"))
    n = max(1, -(-rows.count() // (rows_a_slice or SEARCH_SLICE)))
    cut = stored(rows.repartitionByRange(n, "saved_ms", "seq").withColumn("slice", F.spark_partition_id()))

    def ends(some: list[int], begun: dict[int, list[int]]) -> dict[int, list[int]]:
        def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            _, out = _let_through(np.sort(p["saved_ms"].to_numpy()), begun[key[0]], limit)
            return pd.DataFrame({"slice": [key[0]], "times": [out]})

        found = cut.where(F.col("slice").isin(some)).select("slice", "saved_ms").groupBy("slice").applyInPandas(run, "slice int, times array<long>")
        return {r.slice: list(r.times) for r in found.collect()}

    slices = sorted(r.slice for r in cut.select("slice").distinct().collect())
    begun: dict[int, list[int]] = {s: [] for s in slices}
    left, changed = {}, slices[:-1]
    while changed:
        left |= ends(changed, begun)
        after = {s: left[b] for b, s in zip(slices, slices[1:], strict=False)}
        changed = [s for s in slices[:-1] if s in after and after[s] != begun[s]]
        begun |= after

    def decide(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["saved_ms", "seq"], kind="stable")
        times = p["saved_ms"].to_numpy()
        refused, _ = _let_through(times, begun[key[0]], limit)
        wait, no = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        for a, b, until in refused:
            wait[a:b], no[a:b] = until - times[a:b], True
        return pd.DataFrame({"seq": p["seq"].to_numpy(), "status": np.where(no, "refused", "admitted"), "retry_after_ms": pd.arrays.IntegerArray(wait, ~no)})

    return cut.groupBy("slice").applyInPandas(decide, ADMITTED)


def attach_visits(readings: DataFrame, searches: DataFrame) -> DataFrame:
    """Adds venue_id: the reading's osm_id if the latest search of its block by then listed it, else null.

    searches: (cell, fetched_ms, venues array<struct<osm_id, ...>>). As-of by union: readings and searches of a block's
    day in one sorted window, where a reading takes the last search before it. Each day begins with the last search of
    the days before, so a busy block is cut by days.
    """
    day = lambda c: F.floor(F.col(c) / DAY_MS)
    r = readings.withColumns({"hg_at": F.col("saved_ms"), "hg_kind": F.lit(1), "hg_listed": F.lit(None).cast("array<string>"), "hg_day": day("saved_ms")})
    s = searches.select("cell", F.col("fetched_ms").alias("hg_at"), F.lit(0).alias("hg_kind"), F.col("venues.osm_id").alias("hg_listed"), day("fetched_ms").alias("hg_day"))
    latest = s.groupBy("cell", "hg_day").agg(F.max_by("hg_listed", "hg_at").alias("hg_listed"))
    days = r.select("cell", "hg_day").distinct().join(latest, ["cell", "hg_day"], "full")
    before = Window.partitionBy("cell").orderBy("hg_day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    carried = days.withColumn("hg_listed", F.last("hg_listed", ignorenulls=True).over(before)).where("hg_listed IS NOT NULL")
    carried = carried.select("cell", (F.col("hg_day") * DAY_MS - 1).alias("hg_at"), F.lit(0).alias("hg_kind"), "hg_listed", "hg_day")
    w = Window.partitionBy("cell", "hg_day").orderBy("hg_at", "hg_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(s.unionByName(carried), allowMissingColumns=True).withColumn("hg_listed", F.last("hg_listed", ignorenulls=True).over(w))
    ok = valid_visit() & F.array_contains("hg_listed", F.col("osm_id"))
    return both.where("hg_kind = 1").withColumn("venue_id", F.when(ok, F.col("osm_id"))).drop("hg_at", "hg_kind", "hg_listed", "hg_day")


def cell_rollup(readings: DataFrame) -> DataFrame:
    """(cell, energy, count): what merges. The level is derived last."""
    return readings.groupBy("cell").agg(F.sum(ac.energy_of("laeq")).alias("energy"), F.count("*").alias("count"))


def with_level(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("laeq", ac.level_of(F.col("energy") / F.col("count")))


def venue_hours(readings: DataFrame) -> DataFrame:
    """(venue_id, hour, energy, count) of readings with a venue."""
    return readings.where("venue_id IS NOT NULL").groupBy("venue_id", "hour").agg(F.sum(ac.energy_of("laeq")).alias("energy"), F.count("*").alias("count"))


def venue_levels(hours: DataFrame) -> DataFrame:
    """One pass over the hours: per venue its overall level and count, its quietest hour (the earlier of equals) and
    the 24 levels as an array, null where nobody measured."""
    lv = hours.withColumn("laeq", ac.level_of(F.col("energy") / F.col("count")))
    out = lv.groupBy("venue_id").agg(
        ac.level_of(F.sum("energy") / F.sum("count")).alias("laeq"), F.sum("count").alias("count"),
        F.min(F.struct("laeq", "hour")).alias("q"), F.map_from_entries(F.collect_list(F.struct("hour", "laeq"))).alias("m"),
    )
    slots = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at("m", h))
    return out.select("venue_id", "laeq", "count", F.col("q.hour").alias("quietest_hour"), F.col("q.laeq").alias("quietest_laeq"), slots.alias("hours"))


def venue_facts(visits: DataFrame) -> DataFrame:
    """(venue_id, name, kind, lat, lng) as listed at the venue's first reading."""
    f = F.min_by(F.struct("name", "kind", "lat", "lng"), F.struct("saved_ms", "seq"))
    return visits.where("venue_id IS NOT NULL").groupBy("venue_id").agg(f.alias("f")).select("venue_id", "f.*")


def without(readings: DataFrame, users: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Readings but those of some users (user_id) and those saved in some blocks since a time (cell, since_ms)."""
    if users is not None:
        readings = readings.join(users.select("user_id"), "user_id", "left_anti")
    if blocks is not None:
        b = blocks.groupBy("cell").agg(F.min("since_ms").alias("since_ms"))
        readings = readings.join(b, (readings.cell == b.cell) & (readings.saved_ms >= b.since_ms), "left_anti")
    return readings


def served_cells(rollup: DataFrame, regions: DataFrame) -> DataFrame:
    """What a map sees: cell, laeq, count, band; no user and no time."""
    out = with_level(ce.cells_of_regions(rollup, regions))
    return out.select("cell", "laeq", "count", ac.loudness_band("laeq")["label"].alias("band"))
