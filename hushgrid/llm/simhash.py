"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two halves of 32 bits. Of three differing bits one half holds at most one, so the two
fingerprints agree in that half once the right bit is masked. Each distinct fingerprint is therefore filed under
2 x 32 one-wildcard variants; equal variants are met by an equality join, done as a merge of sorted runs, and each
met pair is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.components import connected_components
from ..plans.shared import stored
from .batches import map_rows

#: Shingle length in words, seed of the shingle hash, differing bits of a link: fixed by the contract.
WORDS, SEED, BITS = 3, 42, 3
#: Runs up to SHORT are verified pair by pair; runs over LONG are filed anew by parts of the other half.
SHORT, LONG = 32, 16_384


def fingerprint(text: str | None) -> int:
    """64-bit SimHash as an unsigned number; 0 for null or a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - WORDS + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def work(cols: list[list]) -> Iterator[tuple]:
        for i, t in zip(*cols, strict=True):
            f = fingerprint(t)
            yield i, f - (1 << 64) if f >> 63 else f

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, fp long")


def _pairs_of_runs(key: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Linked pairs within runs of equal keys: all of a short run's, a spanning forest of a longer one's."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(cut, len(key)))
    a, b = [], []
    length = np.repeat(size, size)
    short = (length > 1) & (length <= SHORT)
    k, f = key[short], fp[short]
    for d in range(1, SHORT):
        same = np.flatnonzero(k[d:] == k[:-d]) if d < len(k) else []
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + d]) <= BITS]
        a.append(f[near])
        b.append(f[near + d])
    for at, n in zip(cut[size > SHORT], size[size > SHORT], strict=True):
        left = fp[at : at + n].copy()
        frontier = []
        while len(left):
            if not frontier:
                frontier.append(left[0])
                left = left[1:]
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= BITS
            if near.any():
                a.append(np.full(int(near.sum()), x, np.uint64))
                b.append(left[near])
                frontier.extend(left[near])
                left = left[~near]
    return a, b


def _merge_runs(batches: Iterator[pa.RecordBatch], defer: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (key, fp) sorted by key: links (a, b, null); with defer, rows (fp, null, key) of runs over LONG, which pass
    through without being held."""

    def out(a, b, key=None):
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if key is None else pa.array(key)], names=["a", "b", "key"])

    def links(key, fp):
        """Of whole runs."""
        if defer:
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(cut, len(key)))
            long = np.repeat(size > LONG, size)
            if long.any():
                yield out(fp[long], None, key[long])
                key, fp = key[~long], fp[~long]
        if len(key):
            a, b = _pairs_of_runs(key, fp)
            if a and (n := np.concatenate(a)).size:
                yield out(n, np.concatenate(b))

    held_k, held_f, passing = [], [], None  # the last run, which may go on in the next batch; the key of one over LONG
    for batch in batches:
        key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if passing is not None:
            n = np.searchsorted(key, passing, side="right")
            if n:
                yield out(fp[:n], None, key[:n])
            key, fp = key[n:], fp[n:]
        if not len(key):
            continue
        passing = None
        last = np.searchsorted(key, key[-1])
        if last or held_k and held_k[-1][-1] != key[0]:
            yield from links(np.concatenate([*held_k, key[:last]]), np.concatenate([*held_f, fp[:last]]))
            held_k, held_f = [], []
        held_k.append(key[last:])
        held_f.append(fp[last:])
        if defer and sum(map(len, held_k)) > LONG:
            passing = key[-1]
            yield out(np.concatenate(held_f), None, np.concatenate(held_k))
            held_k, held_f = [], []
    if held_k:
        yield from links(np.concatenate(held_k), np.concatenate(held_f))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that join the same fingerprints as all links would.

    fps has one long column `fp`, distinct. Every pair of at most BITS differing bits is connected through the
    returned pairs, each of which has at most BITS itself.
    """
    low = "(shiftrightunsigned(fp, IF(i < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, i % 32))"
    filed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).selectExpr(f"shiftleft(CAST(i AS BIGINT), 32) | {low} AS key", "fp")
    first = stored(filed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _merge_runs(it, True), "a long, b long, key long"))
    # A run over LONG shares 31 bits of one half. Of the other half's eight half-bytes a linked pair has five equal ones;
    # runs of equal key and five such leave 13 bits open, so they hold at most 8,192 different fingerprints.
    masks = [sum(15 << 4 * k for k in some) for some in combinations(range(8), 5)]
    again = first.where("b IS NULL").select(F.col("a").alias("fp"), "key", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
    again = again.selectExpr("xxhash64(key, mask, shiftrightunsigned(fp, IF(key < shiftleft(32L, 32), 32, 0)) & mask) AS key", "fp")
    second = again.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _merge_runs(it, False), "a long, b long, key long")
    return first.where("b IS NOT NULL").unionByName(second).select("a", "b").distinct()


def _classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id, root) of each fingerprint in fps (doc_id, fp): the smallest doc_id of its component, and the
    component's smallest fingerprint."""
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    tied = connected_components(links(classes.select("fp")))
    tied = tied.join(classes, tied.node == classes.fp).select("fp", "component", "rep")
    least = tied.groupBy("component").agg(F.min("rep").alias("least"))
    moved = tied.join(least, "component").select("fp", "least", "component")
    # Stored, so that the last join shuffles both sides, and Spark can split the rows of a fingerprint with many copies.
    return stored(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and equal texts share
    a fingerprint, hence a component. A row without doc_id gets its component's smallest id, which is null where
    no member has one. A text is hashed whole, however long. Other columns are ignored. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, doc_id, text))
    return fps.join(_classes(fps), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: one of its smallest doc_id, and of rows with that id the one of the smallest
    text hash. A component without any id keeps a row as well.

    Rows are told apart by (doc_id, hash of the text), so texts that share an id or have none are judged each by itself. Null
    and empty texts are one component, a text is hashed whole, however long, and all columns are carried along. An empty table
    gives no rows.
    """
    key, mark = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(key.alias("hg_id"), mark.alias("hg_mark"), F.struct(*docs.columns).alias("row"))

    def work(cols: list[list]) -> Iterator[tuple]:
        for i, m, t in zip(*cols, strict=True):
            f = fingerprint(t)
            yield i, m, f - (1 << 64) if f >> 63 else f

    fps = stored(map_rows(docs.select(key.alias("doc_id"), mark.alias("mark"), F.col(text).alias("text")), work, "doc_id long, mark long, fp long"))
    # min of a struct puts null first, so an id is wanted before the mark; components have few rows after the map side.
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("hg_id"), F.col("mark").alias("hg_mark"))).alias("pick")
    kept = fps.join(_classes(fps), "fp").groupBy("root").agg(pick).select("pick.hg_id", "pick.hg_mark")
    same = F.col("r.hg_id").eqNullSafe(F.col("k.hg_id")) & (F.col("r.hg_mark") == F.col("k.hg_mark"))
    met = rows.alias("r").join(kept.alias("k"), same, "left_semi")
    return met.dropDuplicates(["hg_id", "hg_mark"]).select("row.*")
