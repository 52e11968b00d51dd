"""Parquet tables that micro-batches add to, in one commit for several tables, and that stay few files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import shared_dir

#: Segments of a level that are rewritten as one of the next level.
FAN = 8
#: Manifests that stay: the last, and the one that its batch would begin with if it ran again.
KEPT = 2


@dataclass(frozen=True)
class Kept:
    """A table of a store. merge(rows, whole) brings rows of several segments together; whole says that nothing older is
    left out. Without it rows only add up. order: by what a segment is sorted, so that filters skip parts of it."""

    schema: str
    merge: Callable[[DataFrame, bool], DataFrame] | None = None
    order: tuple[str, ...] = ()


class Store:
    """Tables in a shared folder. A batch writes a segment of each table into paths of its own, then its manifest: the list
    of all segments that hold after it. The manifest is moved into place, and only that makes the batch count. A batch that
    was killed anywhere before, while it was compacting too, runs again over the same manifest and paths, in this process
    or another.

    As soon as a level has FAN segments they become one of the next level. So after n batches a table has at most FAN times
    log n segments, and a row was rewritten log n times. A batch lists one folder, of KEPT manifests and its own, and
    reads one file; segments that no kept manifest names go. Who reads while batches run holds the segments of the
    last manifest for one more batch.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, Kept], folder: str | None = None) -> None:
        self.spark, self.tables, self.folder = spark, tables, folder or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.calls = 0  # of the file system

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.calls += 1
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        path, fs = self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _load(self, batch: int) -> dict[str, list]:
        path, fs = self._path(f"manifests/{batch}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def segments(self, before: int | None = None) -> dict[str, list]:
        """Of each table its segments [level, name], oldest first, after the last batch (before a batch)."""
        found = [b for b in self._batches() if before is None or b < before]
        return self._load(found[-1]) if found else {t: [] for t in self.tables}

    def _rows(self, name: str, segments: list) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.tables[name].schema)
        return self.spark.read.schema(self.tables[name].schema).parquet(*(f"{self.folder}/{s}" for _, s in segments))

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """A table after the last batch, or as a batch finds it."""
        rows, merge = self._rows(name, self.segments(before).get(name, [])), self.tables[name].merge
        return merge(rows, True) if merge else rows

    def _write(self, rows: DataFrame, name: str, segment: str) -> None:
        order = self.tables[name].order
        (rows.sortWithinPartitions(*order) if order else rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{segment}")

    def _compacted(self, name: str, batch: int, segments: list) -> list:
        level = 0
        while sum(at == level for at, _ in segments) >= FAN:
            full = [s for s in segments if s[0] == level]
            older = [s for s in segments if s[0] > level]
            rows, merge = self._rows(name, full), self.tables[name].merge
            level += 1
            made = [level, f"{name}/{batch}.{level}"]
            self._write(merge(rows, not older) if merge else rows, name, made[1])
            segments = [*older, made, *(s for s in segments if s[0] < level - 1)]
        return segments

    def commit(self, batch: int, rows: dict[str, DataFrame]) -> None:
        """What a batch adds to tables of the store, all of it or nothing."""
        held, now, own = self.segments(batch), {}, set()
        for name in self.tables:
            now[name] = held.get(name, [])
            if name in rows:
                self._write(rows[name], name, f"{name}/{batch}.0")
                now[name] = self._compacted(name, batch, [*now[name], [0, f"{name}/{batch}.0"]])
                # What it wrote and merged at once is named by no manifest.
                top = next(level for level, s in reversed(now[name]) if s.startswith(f"{name}/{batch}."))
                own |= {f"{name}/{batch}.{level}" for level in range(top)}
        self._publish(batch, now)
        self._clean(own)

    def _publish(self, batch: int, now: dict[str, list]) -> None:
        new, fs = self._path(f"manifests/.{batch}.{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(now).encode()))
        finally:
            stream.close()
        path, _ = self._path(f"manifests/{batch}")
        if fs.exists(path):  # of a run that was killed after it: the same segments, as they have just been written again
            fs.delete(path, False)
        if not fs.rename(new, path):
            raise OSError(f"can't publish {path}")

    def _clean(self, own: set[str]) -> None:
        """Old manifests go, and with each the segments that no later one names."""
        for s in own:
            path, fs = self._path(s)
            fs.delete(path, True)
        batches = self._batches()
        named = {s for b in batches[-KEPT:] for segments in self._load(b).values() for _, s in segments} if batches[:-KEPT] else set()
        for b in batches[:-KEPT]:
            for s in {s for segments in self._load(b).values() for _, s in segments} - named:
                path, fs = self._path(s)
                fs.delete(path, True)
            path, fs = self._path(f"manifests/{b}")
            fs.delete(path, False)
