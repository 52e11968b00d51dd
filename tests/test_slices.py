"""Admission in slices of time: the same as in one loop, whatever the size of a slice."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest

from hushgrid.operators import readings as rd


def loop(rows, user, block):
    """{seq: (status, wait)} of rows (seq, user, client, cell, ms), one after the other."""
    held, done, out = defaultdict(deque), set(), {}
    for seq, u, c, cell, ms in sorted(rows, key=lambda r: (r[4], r[0])):
        if (u, c) in done:
            out[seq] = "duplicate", None
            continue
        for key, limit, name in ((("u", u), user, "refused-user"), (("c", cell), block, "refused-block")):
            while held[key] and held[key][0] <= ms - limit.window_ms:
                held[key].popleft()
            if len(held[key]) >= limit.count:
                out[seq] = name, held[key][0] + limit.window_ms - ms
                break
        else:
            done.add((u, c))
            held["u", u].append(ms)
            held["c", cell].append(ms)
            out[seq] = "admitted", None
    return out


@pytest.mark.parametrize("size", [150, 400])
def test_one_block_with_a_third_of_all_rows(spark, monkeypatch, size):
    """Contested for all its time, beside others; users roam between blocks, and retries come slices later."""
    monkeypatch.setattr(rd, "SLICE", size)
    rnd = random.Random(size)
    user, block = rd.Limit(5, 40_000), rd.Limit(4, 15_000)
    rows = [(k, rnd.randrange(30), rnd.randrange(40), "hot" if rnd.random() < 0.35 else f"c{rnd.randrange(12)}", rnd.randrange(400_000) // 50 * 50) for k in range(1500)]
    df = spark.createDataFrame(rows, "seq long, user_id long, client_id long, cell string, saved_ms long").repartition(5)
    got = {r.seq: (r.status, r.retry_after_ms) for r in rd.admit(df, user, block).collect()}
    want = loop(rows, user, block)
    assert got == want and {s for s, _ in want.values()} == {"admitted", "duplicate", "refused-user", "refused-block"}


def test_slices_are_even(spark, monkeypatch):
    """No slice of a single group is much longer than another, and none is decided more often than there are slices."""
    monkeypatch.setattr(rd, "SLICE", 2000)
    rounds, sizes = [0], []
    entries = rd._entries

    def counted(cut, *rest):
        rounds[0] += 1
        if not sizes:
            sizes.extend(r["count"] for r in cut.groupBy("slice").count().collect())
        return entries(cut, *rest)

    monkeypatch.setattr(rd, "_entries", counted)
    rnd = random.Random(2)
    rows = [(k, k, k, "hot", rnd.randrange(3_600_000)) for k in range(16_000)]
    df = spark.createDataFrame(rows, "seq long, user_id long, client_id long, cell string, saved_ms long")
    got = {r.seq: (r.status, r.retry_after_ms) for r in rd.admit(df, rd.USER_LIMIT, rd.Limit(6, 60_000)).collect()}
    assert got == loop(rows, rd.USER_LIMIT, rd.Limit(6, 60_000))
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4] and rounds[0] <= 9


def test_a_dense_timeline_of_searches(spark, monkeypatch):
    """A hundred thousand searches without a gap, in eight slices."""
    monkeypatch.setattr(rd, "SLICE", 12_500)
    rnd = random.Random(3)
    times = [rnd.randrange(1_000_000) for _ in range(100_000)]
    got = {r.seq: (r.status, r.retry_after_ms) for r in rd.search_budget(spark.createDataFrame(list(enumerate(times)), "seq long, saved_ms long")).collect()}
    want = loop([(k, k, k, "all", t) for k, t in enumerate(times)], rd.Limit(1, 0), rd.SEARCH_LIMIT)
    assert got == {k: ("admitted" if s == "admitted" else "refused", w) for k, (s, w) in want.items()}


def test_groups_that_fit_a_slice_hand_nothing_on(spark, monkeypatch):
    """Eight contested blocks are 24,000 rows, of which a slice holds 4,000: each block is decided once, and none is cut."""
    monkeypatch.setattr(rd, "SLICE", 4000)
    monkeypatch.setattr(rd, "LOT", 1000, raising=False)
    monkeypatch.setattr(rd, "_entries", lambda *a: pytest.fail("a block that fits was cut"))
    rnd = random.Random(4)
    user, block = rd.Limit(2, 900_000), rd.Limit(6, 60_000)
    rows = [(k, 8 * rnd.randrange(100) + k % 8, rnd.randrange(60), f"c{k % 8}", rnd.randrange(3_600_000) // 100 * 100) for k in range(24_000)]
    rows += [(k, k, k, f"quiet{k}", rnd.randrange(3_600_000)) for k in range(24_000, 24_050)]
    df = spark.createDataFrame(rows, "seq long, user_id long, client_id long, cell string, saved_ms long")
    got = {r.seq: (r.status, r.retry_after_ms) for r in rd.admit(df, user, block).collect()}
    want = loop(rows, user, block)
    assert got == want and {s for s, _ in want.values()} == {"admitted", "duplicate", "refused-user", "refused-block"}


def test_ids_beyond_what_a_double_holds(spark, monkeypatch):
    """Users and ids that differ by one above 2 ** 53, in a group that is cut into slices."""
    monkeypatch.setattr(rd, "SLICE", 500)
    rnd = random.Random(5)
    user, block, big = rd.Limit(2, 60_000), rd.Limit(3, 10_000), 2**60
    rows = [(k, big + rnd.randrange(40), big + rnd.randrange(30), f"c{rnd.randrange(3)}", rnd.randrange(300_000)) for k in range(1500)]
    df = spark.createDataFrame(rows, "seq long, user_id long, client_id long, cell string, saved_ms long")
    got = {r.seq: (r.status, r.retry_after_ms) for r in rd.admit(df, user, block).collect()}
    assert got == loop(rows, user, block)


def test_full_is_as_many_arrivals_as_the_limit(spark):
    """Over the borders of slots, with equal times and a time that is missing."""
    rnd = random.Random(6)
    rows = [(k, rnd.randrange(6), rnd.choice([None, *range(0, 200_000, 40)]) if k % 50 == 0 else rnd.randrange(200_000) // 40 * 40) for k in range(4000)]
    df = spark.createDataFrame(rows, "seq long, user_id long, saved_ms long")
    for limit in (rd.Limit(1, 40), rd.Limit(4, 1000), rd.Limit(9, 3000)):
        want = {r.seq: r.n >= limit.count for r in rd.with_arrivals(df, "n", "user_id", limit.window_ms).collect()}
        got = {r.seq: r.full for r in rd.with_full(df, "full", "user_id", limit).collect()}
        assert got == want and len(set(want.values())) == 2
