"""Bounded-space online packing of token windows.

Each partition keeps at most `open_windows` windows open. A document's pieces of a full window go out at once; the
rest is placed into the open window that it fills best. When it fits none and no window may be opened, the fullest
is topped up with the start of the piece and emitted. What is open at a partition's end is merged: within the
partition, then over groups of partitions, until one window is left, the only padded one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import stored
from .batches import arrow_schema, small_batches
from .tokens import byte_bpe

#: Partitions whose last windows are merged by one task.
FAN_IN = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.open: list[list] = []  # [used, pieces]
        self.full: list[list[tuple]] = []

    def add(self, doc: object, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.full.append([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            best = max((w for w in self.open if w[0] + len(ids) <= self.size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append(best := [0, []])
            take = len(ids)
            if best is None:
                best = max(self.open, key=lambda w: w[0])
                take = self.size - best[0]
            best[0] += take
            best[1].append((doc, start, ids[:take], total))
            start, ids = start + take, ids[take:]
            if best[0] == self.size:
                self.open.remove(best)
                self.full.append(best[1])

    def taken(self) -> list[list[tuple]]:
        out, self.full = self.full, []
        return out

    def merged(self) -> tuple[list[list[tuple]], list[tuple]]:
        """Full windows made of the open ones, fullest first, and the pieces of the one that is left."""
        rest = Windows(self.size, 1)
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for p in pieces:
                rest.add(*p)
        return rest.taken(), rest.open[0][1] if rest.open else []


def _rows(windows: Iterable[list[tuple]], first: int) -> Iterator[tuple]:
    for k, pieces in enumerate(windows, first):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, k, at, None, None
            at += len(ids)


def _left(pieces: list[tuple], part: int) -> Iterator[tuple]:
    for doc, start, ids, total in pieces:
        yield doc, start, len(ids), 0, total, None, None, part, ids.astype("<u4").tobytes()


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, open_windows: int = 32, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its byte-BPE ids and then end_id; null and empty texts are the end_id alone, and a row
    without doc_id is packed under a null id. Repeated rows are packed each for itself. Ids lie in exactly one
    piece; a sequence's pieces lie gapless from offset 0, and all sequences but one are full. Sequence ids depend
    on how the input is split, not on the order in which tasks end. A text is encoded whole, however long. Other columns
    are ignored. An empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    names, types = arrow_schema(source, SCHEMA)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, n, part = byte_bpe(vocabulary), Windows(size, open_windows), 0, 0
        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc, t, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.concatenate((encode(t), end)) if t else end
                windows.add(doc, 0, ids, len(ids))
            if windows.full:
                done = windows.taken()
                yield batch(list(_rows(done, (part << 32) + n)))
                n += len(done)
        done, left = windows.merged()
        if rows := [*_rows(done, (part << 32) + n), *_left(left, part)]:
            yield batch(rows)

    def later_pass(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of one group of partitions follow each other."""

            def closed(group: int, rows: list[tuple]) -> pa.RecordBatch:
                windows = Windows(size, open_windows)
                for r in rows:
                    windows.add(r[0], r[1], np.frombuffer(r[8], "<u4"), r[4])
                full = windows.taken()
                more, left = windows.merged()
                return batch([*_rows(full + more, (level << 56) + (group << 24)), *_left(left, group)])

            group, rows = None, []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if rows and r[7] // FAN_IN != group:
                        yield closed(group, rows)
                        rows = []
                    group = r[7] // FAN_IN
                    rows.append(r)
            if rows:
                yield closed(group, rows)

        return run

    done = stored(small_batches(source).mapInArrow(first_pass, SCHEMA))
    out = done.where("ids IS NULL")
    parts = (done.where("ids IS NOT NULL").agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        left = done.where("ids IS NOT NULL").repartition((F.col("part") / FAN_IN).cast("long")).sortWithinPartitions("part", "doc_id", "start")
        done = stored(left.mapInArrow(later_pass(level), SCHEMA))
        out = out.unionByName(done.where("ids IS NULL"))
        parts = -(-parts // FAN_IN)
        if parts == 1:
            break

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The one window that is left. Its pieces hold fewer than `size` ids, so they make one small batch."""
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            yield batch(list(_rows([[(r[0], r[1], np.frombuffer(r[8], "<u4"), r[4]) for r in rows]], (level + 1) << 56)))

    rest = done.where("ids IS NOT NULL").coalesce(1).sortWithinPartitions("doc_id", "start").mapInArrow(last, SCHEMA)
    return out.unionByName(rest).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
