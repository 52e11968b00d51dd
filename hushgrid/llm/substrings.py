"""Exact removal of repeated passages by seeds and their extension.

Seeds are winnowed anchors: of a window's overlapping 5-word grams the one of smallest hash (the leftmost of equals),
so that equal windows have equal anchors at the same place, and one anchor serves about eight windows. Documents
meet on equal anchors. A seed is extended both ways over all windows that it serves (its span). Spans of equal
words are repeats as a whole: all but the first are removed. Where an anchor has different spans, as at the ends of
a repeat, the first of each are compared window by window. Overlapping results add up to maximal repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.shared import stored
from .batches import WordHashes, map_rows, mix, small_batches, words_of

#: Words of an anchor.
GRAM = 5
#: Words that are hashed together in one piece of numpy work.
CHUNK = 400_000
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """Hashes of any stretch of words of some documents, laid end to end."""

    def __init__(self, docs: list[list[bytes]], memo: WordHashes) -> None:
        self.size = np.array([len(d) for d in docs], np.int64)
        self.first = np.cumsum(self.size) - self.size
        n = int(self.size.sum())
        self.words = np.concatenate([memo.of(d) for d in docs]) if n else np.zeros(0, np.uint64)
        up, self.down = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * up[:n], dtype=np.uint64)))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of words start..end-1, whatever stands before."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(h: Hashed, window: int) -> tuple[np.ndarray, ...]:
    """For each anchor that serves a window: document, its hash, its span's hash, first window, number of windows."""
    n = len(h.words)
    ends = h.first + h.size
    place = np.repeat(np.arange(len(h.size)), h.size)
    if n < window:
        return (np.zeros(0, np.int64),) * 5
    gram = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at = np.arange(n - GRAM + 1)
    gram[: n - GRAM + 1] = h.stretch(at, at + GRAM)  # those across a border of documents serve no window
    best, covered, wide = np.arange(n), 1, window - GRAM + 1
    while covered < wide:  # leftmost minimum of `covered` grams, doubled until it is `wide`
        step = min(covered, wide - covered)
        right = best[step:]
        left = best[: n - step]
        best = np.where(gram[left] <= gram[right], left, right)
        best = np.concatenate((best, np.full(step, n - 1)))
        covered += step
    start = np.flatnonzero(np.arange(n) + window <= ends[place])
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    own = best[start]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.append(new, len(start)))
    begin, anchor = start[new], own[new]
    span = h.stretch(begin, begin + count + window - 1)
    span = mix(span ^ (count.astype(np.uint64) << np.uint64(32)) ^ (anchor - begin).astype(np.uint64))
    doc = place[begin]
    return doc, gram[anchor], span, begin - h.first[doc], count


def _chunks(docs: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part, n = [], 0
    for words in docs:
        part.append(words)
        n += len(words)
        if n >= CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, anchor, span, start, n) of every anchor of every document.

    Of equal spans that are hashed together only the first keeps its anchor. The others are repeats already: their
    n is negative, and their anchor a number of their own. So an anchor that a large share of all documents hold is
    thinned out before the shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("span", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            ids, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for part in _chunks(words_of(t.as_py()) for t in b.column(2)):
                doc, anchor, span, start, n = anchors(Hashed(part, memo), window)
                doc = doc + at
                at += len(part)
                if len(doc):
                    order = np.lexsort((start, th[doc], ids[doc], span, anchor))
                    new = np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (span[order][1:] != span[order][:-1])))
                    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first occurrence, for each in order
                    again = order[(ids[doc[order]] != ids[doc[lead]]) | (th[doc[order]] != th[doc[lead]]) | (start[order] != start[lead])]
                    n[again] *= -1
                    anchor[again] = mix(span[again] ^ mix(ids[doc[again]].view(np.uint64) + start[again].view(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(th[doc]), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], schema=schema)

    return small_batches(docs).mapInArrow(run, "doc_id long, th long, anchor long, span long, start int, n int")


def _windows(docs_and_spans: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, anchor, hash, start) of each window of the given spans; rows are (doc_id, th, text, spans)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("hash", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            for k in range(b.num_rows):
                h = Hashed([words_of(b.column(2)[k].as_py())], memo)
                anchor, start, n = (b.column(3)[k].values.field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "start", "n"))
                each = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                m = len(each)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, b.column(0)[k].as_py())), pa.array(np.full(m, b.column(1)[k].as_py())), pa.array(np.repeat(anchor, n)), pa.array(h.stretch(each, each + window).view(np.int64)), pa.array(each.astype(np.int32))], schema=schema)

    return small_batches(docs_and_spans).mapInArrow(run, "doc_id long, th long, anchor long, hash long, start int")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A document is known by its id (a null id comes last) and its text's hash."""
    return docs.select(*_key(doc_id, text), F.col(text).alias("text"))


def _key(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th")]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, th, start, end): stretches of words that are covered by windows with an earlier equal window.

    Earlier is a smaller doc_id, or in the same document a smaller start; rows of one id but different texts are
    ordered by th, the text's hash, and rows equal in both are one document, here and in `remove`.
    """
    source = _keyed(docs, doc_id, text)
    first = ["doc_id", "th", "start"]
    # One shuffle by anchor, and one sort: equal spans follow each other, the first occurrence in front.
    place = F.rank().over(Window.partitionBy("anchor", "span").orderBy(*first))
    met = _seeds(source, window).repartition("anchor").withColumn("place", place)
    met = met.withColumn("firsts", F.sum(F.when(F.col("place") == 1, 1)).over(Window.partitionBy("anchor")))
    met = stored(met.where("place > 1 OR firsts > 1 OR n < 0"))
    whole = met.where("place > 1 OR n < 0").select("doc_id", "th", "start", (F.col("start") + F.abs("n") + window - 1).alias("end"))
    # An anchor with different spans: windows of the first occurrence of each.
    part = met.where("place = 1 AND n > 0").groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("spans"))
    each = _windows(source.join(part, ["doc_id", "th"]).select("doc_id", "th", "text", "spans"), window)
    again = each.withColumn("place", F.rank().over(Window.partitionBy("anchor", "hash").orderBy(*first))).where("place > 1")
    return whole.unionByName(again.select("doc_id", "th", "start", (F.col("start") + window).alias("end")))


def _joined(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """(row, text, spans): each row of docs as a struct, its text, and its sorted [start, end) stretches or null."""
    found = repeats(docs, doc_id, text, window).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_key(doc_id, text))
    return rows.join(found, ["doc_id", "th"], "left").select("row", F.col("row")[text].alias("text"), "spans")


def _covered(n: int, spans: list | np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    for s in spans:
        out[s["start"] : s["end"]] = True
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """docs with the repeated words taken out of `text`, kept words and the white space in front of them unchanged.

    Null and empty texts stay as they are; texts without repeats keep every character. Columns of any name are carried
    along. Rows of one id and equal texts are one document and come out alike. A text is taken whole, however long. An
    empty table gives no rows.
    """
    @F.pandas_udf("string")
    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        token = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t and s is not None and len(s):
                raw = t.encode("utf-8", "surrogatepass")
                words = token.findall(raw)
                gone = _covered(len(words), s)
                t = b"".join(w for w, g in zip(words, gone, strict=True) if not g).lstrip().decode("utf-8", "surrogatepass")
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = small_batches(_joined(docs, doc_id, text, window))
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(left(F.col("text"), F.col("spans")))
    return joined.withColumn("text", new).select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def repeat_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Null and empty texts have no words. Rows of one id and equal texts are one document and come out alike. A row
    without id ranks behind all others. A text is taken whole, however long. Other columns are ignored. An empty table
    gives no rows.
    """

    def work(cols: list[list]) -> Iterator[tuple]:
        for i, t, spans in zip(*cols, strict=True):
            words = words_of(t)
            kept = words
            if spans:
                gone = _covered(len(words), spans)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            yield i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = _joined(wanted, "doc_id", "text", window).select("row.doc_id", "text", "spans")
    return map_rows(joined, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")
