"""Whitening of embeddings, fitted once for each distinct vector.

Equal vectors are grouped first, with their number: a vector's number, or one, is its weight in the fit. The mean comes
from exact integer sums, the covariance from weighted products of centred blocks (two passes over the distinct vectors), and
its largest eigenvectors are the components. Each distinct vector is whitened once, then joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.shared import stored
from .batches import arrow_schema, small_batches

#: Components by default, units of an integer component, and the part of the largest eigenvalue below which, for each
#: dimension, an eigenvalue is rounding.
COMPONENTS, SCALE, ROUNDING = 4, 256, 1e-15
#: A vector of more than one in so many rows is common. There are fewer common vectors than this.
COMMON = 1000
#: Integer components lie below this in size, so that sums of squares and products with sums stay exact.
LARGEST = 2**31


@dataclass(frozen=True)
class Whitening:
    """The fit of the vectors of one length: weight n, exact sums, covariance, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    mean: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, n: int, sums: list[int], covariance: np.ndarray, components: int) -> Whitening:
        """The components by falling eigenvalue, each with its largest entry positive. Those of eigenvalue zero are left
        out: nothing varies along them."""
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        real = values > max(values[0], 0) * len(sums) * ROUNDING if len(values) else np.zeros(0, bool)
        values, vectors = values[real], vectors[:, real]
        if len(values):
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        return cls(n, sums, covariance, vectors, values, _mean(sums, n))

    @property
    def explained(self) -> list[float]:
        trace = float(np.trace(self.covariance))
        return [float(v) / trace for v in self.values]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S) ** 2 for each row, exact. Products of vectors are 64-bit while these can't
        overflow; what follows, a few products a row, is in whole numbers of any size."""
        most = len(self.sums) * int(np.abs(x).max(initial=0))
        square = (x * x if most * most < 2**62 else x.astype(object) ** 2).sum(axis=1).tolist()
        mixed = (x if most * max(map(abs, self.sums), default=0) < 2**62 else x.astype(object)) @ np.array(self.sums)
        total = sum(s * s for s in self.sums)
        return [self.n * self.n * a - 2 * self.n * b + total for a, b in zip(square, mixed.tolist(), strict=True)]


def _mean(sums: list[int], n: int) -> np.ndarray:
    return np.array([s / n for s in sums], np.float64)


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x, h): x holds floor(scale * c) of every component c as double, h is a 128-bit hash of x. Null vectors and
    those with a null or non-finite component are left out. A component beyond LARGEST fails the job: its products
    would not be exact."""
    whole = F.col(embedding).isNotNull() & F.forall(embedding, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    low = lambda c: F.floor(scale * c.cast("double"))
    exact = F.when(F.forall(embedding, lambda c: F.abs(scale * c.cast("double")) < LARGEST), F.transform(embedding, lambda c: low(c).cast("long")))
    x = F.coalesce(exact, F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")).cast("array<bigint>"))
    rows = vectors.where(whole).select(F.col(vec_id).alias("vec_id"), x.alias("x"))
    return rows.select("vec_id", "x", F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit("second"), "x").alias("b")).alias("h"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x, h, dims, copies): each distinct vector once, with its number of rows. Counts combine before the shuffle, so a
    vector that many rows share is no burden."""
    return rows.groupBy("h", "x").agg(F.count("*").alias("copies")).withColumn("dims", F.size("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _products(distinct: DataFrame, mean: np.ndarray, weighted: bool) -> np.ndarray:
    """The weighted sum of (x - mean)' (x - mean): a task multiplies its blocks, Spark adds the tasks' rows up."""
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                x = _matrix(b) - mean
                w = b.column("copies").to_numpy() if weighted else np.ones(b.num_rows)
                total += (x * w[:, None]).T @ x
        row, column = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(total.ravel())], names=["i", "j", "p"])

    parts = small_batches(distinct.select("x", "copies")).mapInArrow(run, "i long, j long, p double")
    out = np.zeros((dims, dims))
    for r in parts.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # dims * dims numbers
        out[r.i, r.j] = r.p
    return (out + out.T) / 2


def _sums(distinct: DataFrame, weighted: bool) -> list[int]:
    """The exact sum of each dimension: a task adds high and low halves apart, Spark adds the tasks' sums as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                w = b.column("copies").to_numpy()[:, None] if weighted else 1
                high, low = high + ((x >> 16) * w).sum(axis=0), low + ((x & 0xFFFF) * w).sum(axis=0)
        if not isinstance(high, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    parts = small_batches(distinct.select("x", "copies")).mapInArrow(run, "i long, high long, low long")
    whole = F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)"))
    return [int(r[1]) * 2**16 + int(r[2]) for r in sorted(parts.groupBy("i").agg(*whole).collect())]  # a row a dimension


def fit(distinct: DataFrame, components: int = COMPONENTS, weights: str = "one") -> Whitening | None:
    """The whitening of distinct vectors (x, copies) of one length. weights: `one` for each distinct vector, or `counts`,
    each as often as it occurs. Without vectors there is none."""
    weighted = weights == "counts"
    n = distinct.agg(F.sum("copies") if weighted else F.count("*")).first()[0]
    sums = _sums(distinct, weighted)
    if not n or not sums:
        return None
    return Whitening.of(n, sums, _products(distinct, _mean(sums, n), weighted) / n, components)


def whitened(distinct: DataFrame, model: Whitening) -> DataFrame:
    """(h, copies, deviation, w): each distinct vector whitened, w with an entry for each component."""
    schema = "h struct<a: bigint, b: bigint>, copies long, deviation decimal(38,0), w array<double>"
    names, types = arrow_schema(distinct, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                far = [Decimal(d) if d < 10**38 else None for d in model.deviations(x)]
                columns = [b.column("h"), b.column("copies"), pa.array(far, types[2]), pa.array(list(model.whiten(x)), types[3])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(distinct.select("x", "h", "copies")).mapInArrow(run, schema)


def identity_error(found: DataFrame, k: int, weights: str = "one") -> float:
    """The largest absolute entry of the whitened vectors' own covariance, less the identity. Centred once more."""
    w = F.col("copies") if weights == "counts" else F.lit(1)
    mean = found.agg(F.sum(w).alias("n"), *(F.sum(F.col("w")[i] * w).alias(f"m{i}") for i in range(k))).first()
    part = lambda i: F.col("w")[i] - mean[f"m{i}"] / mean.n
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = found.agg(*(F.sum(part(i) * part(j) * w).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"c{i}_{j}"] / mean.n - (i == j)) for i, j in pairs)


def join_back(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """rows (h, ...) with what was found for their vector. A common vector, and there are fewer than COMMON of them, goes to
    all tasks; so the rows that share one are not brought together. The others meet by a shuffle on the hash."""
    common = F.col("copies") * COMMON > total
    often, seldom = found.where(common), found.where(~common)
    hot = rows.join(F.broadcast(often), "h")
    return hot.unionByName(rows.join(F.broadcast(often.select("h")), "h", "left_anti").join(seldom, "h"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold a null or non-finite component take no part; a null id is kept, and repeated rows are
    returned each for itself. Vectors of different length are fitted apart, one length after the other. Components along
    which nothing varies (of a single vector, of equal ones, of empty ones: all) don't exist, and have no rows. deviation is
    exact, a decimal of 38 digits, null beyond; with weights `one` it tells n * x from the sums over distinct vectors.
    Equal eigenvalues leave the choice of components open. Other columns are ignored. An empty table gives no rows.
    """
    schema = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors, vec_id, embedding)
    distinct = stored(distinct_vectors(rows))
    lengths = distinct.groupBy("dims").agg(F.sum("copies").alias("total"), F.count("*").alias("n"), F.count_distinct("h").alias("hashes")).orderBy("dims").collect()
    out: list[DataFrame] = []
    for length in lengths:  # embeddings of a model have one
        own = distinct.where(F.col("dims") == length.dims)
        if length.hashes < length.n:  # never seen in 128 bits: but then the rows would be joined to two vectors
            raise ValueError("two vectors share a hash")
        model = fit(own, components, weights)
        if model is None or not len(model.values):
            continue
        found = stored(whitened(own, model))
        error = identity_error(found, len(model.values), weights)
        each = join_back(rows.where(F.size("x") == length.dims).select("vec_id", "h"), found, length.total)
        parts: list[Column] = [F.struct(F.lit(i + 1).alias("component"), F.col("w")[i].alias("whitened"), F.lit(e).alias("explained")) for i, e in enumerate(model.explained)]
        each = each.select("vec_id", "deviation", F.explode(F.array(*parts)).alias("c"))
        out.append(each.select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error")))
    if not out:
        return vectors.sparkSession.createDataFrame([], schema)
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
