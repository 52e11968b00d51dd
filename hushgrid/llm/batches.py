"""Helpers for the Arrow batches that Spark hands to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Held-out rows are those whose remainder is 0.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 by FOLDS. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


#: Rows of a batch between Spark and Python. Texts may be long, and both sides hold a batch or two at a time.
BATCH = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session set to hand over batches of at most BATCH rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df


def map_rows(df: DataFrame, work: Callable[[list[list]], Iterable[tuple]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with plain lists: work takes the columns of some rows and returns one tuple for each output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = list(zip(*work([c.to_pylist() for c in batch.slice(at, rows).columns]), strict=True))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    names, types = arrow_schema(df, schema)
    return small_batches(df).mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for at most `most` words."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8; bytes.split() cuts at just these six characters. None for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
