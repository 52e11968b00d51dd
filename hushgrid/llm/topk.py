"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers. A block of candidates is indexed as posting segments: for each dimension and quantised impact
(a range of STEP) the vectors that have it, with their exact component. A query takes the segments of all dimensions by
descending contribution, whatever its sign, and adds their postings to three accumulators of each candidate: the score so
far, and the squares of the candidate's and of the query's components that are still unread. What is unread can't change a
score by more than the root of the product of these two sums. A query starts from the k-th best exact score of a small
sample, which no block needs to beat again, and stops only when this proves that few candidates can still be among its k
best; these possible members are rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .batches import small_batches

#: Candidates of a block, at most and at least, and queries that meet it in one task; together they bound a task's memory.
BLOCK, LEAST, QUERIES = 16_384, 2048, 65_536
#: Candidates, picked by hash, that every query is scored against beforehand.
SAMPLE = 1024
#: Width of a quantised impact, and the share of a block that is rescored as soon as no more can be members.
STEP, RESCORED = 64, 0.2
#: The shares of all postings after which a proof is tried.
TRIES = np.arange(4, 17) / 16


class ImpactIndex:
    """The index of one block: ids (sorted), their numbers of copies, integer vectors, and posting segments."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        at = np.lexsort((copies, ids))
        self.ids, self.copies, self.vectors = ids[at], copies[at], vectors[at]
        n, dims = vectors.shape
        level = np.floor_divide(self.vectors, STEP)
        # Postings lie dimension by dimension, within it level by level: a segment is one stretch.
        order = np.argsort(level, axis=0, kind="stable").T
        self.posting = order.ravel().astype(np.int32)
        self.component = np.take_along_axis(self.vectors.T, order, 1).ravel().astype(np.float64)
        level = np.take_along_axis(level.T, order, 1)
        new = np.ones((dims, n), bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        self.start = np.flatnonzero(new.ravel())
        self.size = np.diff(np.append(self.start, n * dims))
        self.dim = self.start // max(1, n)
        low = level.ravel()[self.start].astype(np.float64) * STEP
        self.impact = np.maximum(np.abs(low), np.abs(low + STEP - 1))
        self.square = (self.vectors.astype(np.float64) ** 2).sum(axis=1)

    def search(self, query: np.ndarray, k: int, own: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the k best candidates but those of the id `own`, ties to smaller ids, their exact scores, and the
        number of postings read. What scores below the floor may be missing."""
        n = len(self.ids)
        q = query.astype(np.float64)
        free = self.ids != own
        order = np.argsort(-np.abs(q[self.dim]) * self.impact, kind="stable")
        upto = np.cumsum(self.size[order])
        score, unread, asked = np.zeros(n), self.square.copy(), np.full(n, (q * q).sum())
        members, read, at = np.flatnonzero(free), 0, 0
        tries = np.unique(np.searchsorted(upto, TRIES * upto[-1])) + 1 if len(upto) else []
        for end in tries:
            if len(members) <= max(k, RESCORED * n):
                break
            some, at = order[at:end], end
            size = self.size[some]
            where = np.repeat(self.start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            who, x, y = self.posting[where], self.component[where], np.repeat(q[self.dim[some]], size)
            score += np.bincount(who, x * y, n)
            unread -= np.bincount(who, x * x, n)
            asked -= np.bincount(who, y * y, n)
            read += len(who)
            # Squares beyond 2 ** 53 are rounded: a little more than the bound allows for it.
            more = np.sqrt(np.maximum(unread, 0) * np.maximum(asked, 0)) + 1 + 1e-9 * np.abs(score) + 1e-6 * np.sqrt(self.square * (q * q).sum()) * (self.square > 2.0**50)
            bar = floor
            if len(members) > k:
                least = (score - more)[members]
                bar = max(floor, np.partition(least, -k)[-k])
            members = np.flatnonzero(free & (score + more >= bar))
        exact = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -exact))[:k]
        best = best[exact[best] >= floor]
        return members[best], exact[best], read


def as_integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, dims, copies): floor(1024 * x) of every component x as double, without vectors that are null or hold
    a null or non-finite component, or rows without id. Equal rows are one, with their number."""
    whole = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    # No product of two vectors exceeds the product of their lengths.
    square = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + (1024 * F.abs(x.cast("double")) + 1) ** 2)
    v = F.when(square < 2.0**62, F.transform(embedding, lambda x: F.floor(1024 * x.cast("double")).cast("long"))).otherwise(F.raise_error(F.lit("a vector too long for scores of 64 bits")).cast("array<bigint>"))
    rows = vectors.where(whole & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("dims", F.size("v"))


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("v")
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1 if table.num_rows else 0)


def with_floors(asked: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """asked with `floor`: the k-th best exact score in a sample of base, or null where the sample has fewer rows."""
    rows = base.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).select("vec_id", "v").collect()  # at most SAMPLE
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {len(r.v) for r in rows}:
        own = [r for r in rows if len(r.v) == dims]
        sample[dims] = np.array([r.vec_id for r in own], np.int64), np.array([r.v for r in own], np.int64).reshape(len(own), dims)
    shared = asked.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), None
        for b in batches:
            floors = []
            for q, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                ids, vectors = shared.value.get(len(v), none)
                other = ids != q
                floors.append(int(np.partition(vectors[other] @ np.array(v, np.int64), -k)[-k]) if other.sum() >= k else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.int64())], names=[*b.schema.names, "floor"])

    return small_batches(asked).mapInArrow(run, StructType([*asked.schema.fields, StructField("floor", LongType())]))


def _deal(n: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))


def _copied(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best rows of vectors by integer inner product.

    A query's own id is no candidate, whatever row has it. Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without id. A query meets the vectors of its own length only; empty vectors
    score 0. A vector whose squared length as integers is 2 ** 62 or more fails the job: its scores may have no long. Repeated rows are candidates each for itself, and are indexed once. Ties go to the smaller id. Other columns
    are ignored. Without queries or candidates there are no rows. Blocks hold at most some BLOCK rows of any length.
    """
    base, asked = as_integers(vectors, vec_id, embedding), as_integers(queries, vec_id, embedding)
    n, m = max(1, base.count()), max(1, asked.count())
    # Enough blocks for all cores, as long as they aren't small. A query goes to every block once; the candidates are
    # copied only for each QUERIES queries.
    cores = base.sparkSession.sparkContext.defaultParallelism
    blocks, groups = max(-(-n // BLOCK), min(4 * cores, -(-n // LEAST))), -(-m // QUERIES)
    asked = with_floors(asked, base, k)
    base = base.select(_deal(blocks).alias("block"), _copied(groups).alias("part"), "dims", "vec_id", "copies", "v")
    asked = asked.select(_copied(blocks).alias("block"), _deal(groups).alias("part"), "dims", "vec_id", "copies", "v", "floor")

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if candidates.num_rows and wanted.num_rows:
            index = ImpactIndex(candidates.column("vec_id").to_numpy(), candidates.column("copies").to_numpy(), _matrix(candidates))
            of = zip(wanted.column("vec_id").to_pylist(), wanted.column("copies").to_pylist(), wanted.column("floor").to_pylist(), _matrix(wanted), strict=True)
            for q, copies, floor, vector in of:
                places, scores, _ = index.search(vector, k, q, -np.inf if floor is None else floor)
                for column, values in zip(out, (np.full(len(places), q), index.ids[places], scores, index.copies[places] * copies), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "vec_id", "score", "copies"])

    # So many partitions as pairs of blocks: the rows are few but each pair is much work, which adaptive merging of
    # small partitions would put into few tasks.
    key, tasks = ["block", "part", "dims"], min(10_000, 2 * blocks * groups)
    pairs = base.repartition(tasks, *key).groupBy(*key).cogroup(asked.repartition(tasks, *key).groupBy(*key))
    return best_of_blocks(pairs.applyInArrow(search, "query_id long, vec_id long, score long, copies long"), k)


def best_of_blocks(found: DataFrame, k: int) -> DataFrame:
    """The k best of the blocks' best: at most k rows come from a block, each for `copies` equal ones."""
    each = found.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
