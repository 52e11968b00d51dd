"""Whitening against a plain version in NumPy, on awkward rows and on the small table."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hushgrid.llm import whitening
from hushgrid.llm.queries import QUERIES

from ..conftest import SF

SCHEMA = "vec_id long, embedding array<float>, x string, h string, w string, copies string, dims string"


def plain(rows, weights="one", k=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} of rows (id, vector) that all have one length."""
    ints = {}
    xs = [tuple(int(math.floor(256 * float(np.float32(c)))) for c in v) for _, v in rows]
    for x in xs:
        ints[x] = ints.get(x, 0) + 1
    each = list(ints)
    w = np.array([ints[x] if weights == "counts" else 1 for x in each])
    n, a = int(w.sum()), np.array(each, float)
    sums = [sum(x[i] * int(m) for x, m in zip(each, w)) for i in range(a.shape[1])]
    c = a - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh((c * w[:, None]).T @ c / n)
    out = {}
    for i in range(k):
        e, v = values[-1 - i], vectors[:, -1 - i]
        v = v * np.sign(v[np.abs(v).argmax()])
        for (vec_id, _), x in zip(rows, xs):
            dev = sum((n * q - s) ** 2 for q, s in zip(x, sums))
            out[vec_id, i + 1] = (n, dev, float((np.array(x) - np.array([s / n for s in sums])) @ v / math.sqrt(e)), float(e / values.sum()))
    return out


def same(got, want):
    got = {(r.vec_id, r.component): r for r in got}
    assert got.keys() == want.keys()
    for key, (n, dev, w, explained) in want.items():
        r = got[key]
        assert (r.n, int(r.deviation)) == (n, dev)
        assert r.whitened == pytest.approx(w, rel=1e-7, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-6


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    same(QUERIES["op13_whitening"](spark, sf).collect(), plain([(r.vec_id, r.embedding) for r in rows if r.embedding and all(map(math.isfinite, r.embedding))]))


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_common_vectors(spark, weights):
    """A third of all rows share a vector, others come twice or differ by less than a unit."""
    rng = np.random.default_rng(3)
    rows = [(i, [0.5, -0.25, 0.125, 1.0, 0.0]) for i in range(1500)]
    rows += [(2000 + i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(1400)]
    rows += [(4000 + i, rows[1500 + i][1]) for i in range(700)]
    rows += [(5000, [0.5001, -0.2499, 0.1251, 1.0001, 0.0001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = whitening.whiten(df, weights=weights).collect()
    same(got, plain(rows, weights))
    assert got[0].n == (1400 + 1 if weights == "one" else len(rows))


def test_awkward(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist()) for i in range(6)]
    more = [(100 + i, rng.normal(size=2).tolist()) for i in range(3)]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [1.0, float("nan"), 0.0]), (10, [float("inf"), 0.0, 0.0]), (11, []), (12, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*r, *"aaaaa") for r in [*good, good[0], *more, *bad, (None, good[1][1])]], SCHEMA)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    # The null id is kept, a repeated row is returned twice, a single vector of its length has no component.
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [0, 1, 2, 3, 4, 5, 100, 101, 102]
    assert sum(r.vec_id == 0 for r in got) == 6 and sum(r.vec_id is None for r in got) == 3
    same([r for r in got if r.vec_id is not None and r.vec_id < 100], plain(good, k=3))
    same([r for r in got if r.vec_id is not None and r.vec_id >= 100], plain(more, k=2))
    assert all(r.n == (6 if r.vec_id is None or r.vec_id < 100 else 3) for r in got)
    none = whitening.whiten(df.where("vec_id IN (7, 8, 11, 12)"))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(df.limit(0)).count() == 0
    equal = spark.createDataFrame([(i, [0.1, 0.2]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(equal).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, 5.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")).collect()


def test_deviations_are_exact():
    """Beyond 64 bits too."""
    x = np.array([[2**30, -(2**30) + 1], [3, 4]])
    sums = [10**15 + 7, -(10**14)]
    model = whitening.Whitening(10**9, sums, np.eye(2), np.eye(2), np.ones(2), np.zeros(2))
    assert model.deviations(x) == [sum((10**9 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
