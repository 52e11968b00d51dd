"""Elements of a sorted column by their rank, without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Parts that a range of values is cut into in each round.
PARTS = 1024


def elements_at(rows: DataFrame, value: str, ranks: list[int], times: str | None = None) -> dict[int, float]:
    """{rank: value}: the elements at some ranks (from 0) of the sorted values, nulls left out. Ranks beyond the end have none.
    times: a column of how often each value counts, once without it.

    Rounds of counts: the range that holds a rank is cut into PARTS, of which the counts say where the rank lies, and their
    least and largest values are the next range, until these are equal. Only PARTS rows for each rank reach the driver in a
    round, and the values are never shuffled or brought into one task.
    """
    v, n = F.col(value), F.col(times) if times else F.lit(1)
    whole = rows.where(v.isNotNull()).agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    # Of each rank: values below its range, and the range's ends.
    open_ranks = {k: (0, whole.lo, whole.hi) for k in ranks if 0 <= k < whole.n}
    found: dict[int, float] = {}
    while True:
        found |= {k: lo for k, (_, lo, hi) in open_ranks.items() if lo == hi}
        open_ranks = {k: r for k, r in open_ranks.items() if k not in found}
        if not open_ranks:
            return found
        ranges = sorted({(lo, hi) for _, lo, hi in open_ranks.values()})
        part = lambda lo, hi: F.least(F.floor((v - F.lit(lo)).cast("double") / (float(hi) - float(lo)) * PARTS), F.lit(PARTS - 1))
        each = F.explode(F.filter(F.array(*(F.when(v.between(lo, hi), F.struct(F.lit(i).alias("i"), part(lo, hi).alias("b"))) for i, (lo, hi) in enumerate(ranges))), lambda x: x.isNotNull()))
        counts = rows.select(v.alias("v"), n.alias("n"), each.alias("at")).groupBy("at.i", "at.b").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "b").collect()
        for k, (below, lo, hi) in open_ranks.items():
            for r in (r for r in counts if ranges[r.i] == (lo, hi)):
                if k < below + r.n:
                    open_ranks[k] = below, r.lo, r.hi
                    break
                below += r.n


def median(rows: DataFrame, value: str, times: str | None = None) -> float | None:
    """The median of a column, the mean of the two in the middle; None without values. times as in elements_at."""
    n = rows.where(F.col(value).isNotNull()).agg(F.sum(times) if times else F.count("*")).first()[0]
    if not n:
        return None
    at = elements_at(rows, value, [(n - 1) // 2, n // 2], times)
    return (at[(n - 1) // 2] + at[n // 2]) / 2
