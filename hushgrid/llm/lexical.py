"""Ranked lexical search of many items at once: what items share is evaluated once.

The items' term sets are mined for shared subsets: again and again the two sets that share most terms give these up to a
set of their own. What comes out is a graph without cycles, in which an item or a shared set is a sum of shared sets and of a
few terms of its own. Each task turns a batch of documents into impacts, term by term, adds up the accumulators of the
shared sets once each, in the order of the graph, and combines the items' scores from them. All of it is whole numbers, so
the order of additions doesn't matter. A task passes on its best of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.shared import stored
from .batches import arrow_schema, map_rows, small_batches

#: Items mined together; items, and different terms of them, for which one pass over the documents looks. All three bound what
#: the driver and a task hold.
GROUP, ITEMS, VOCABULARY = 256, 16_384, 500_000
#: Sets that share fewer terms than this keep them.
SHARED = 2
#: Documents whose accumulators a task holds at once.
DOCS = 2048
#: The best of an item by default.
BEST = 50

#: Every ASCII character but digits and letters ends a term; capitals of ASCII become small.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of anything beyond ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Sharing:
    """Sums of the graph: set number k is the sum of the sets children[k], all of higher number, and of the terms own[k]. The
    first sets are the items."""

    items: int
    children: list[list[int]]
    own: list[list[int]]

    @property
    def additions(self) -> int:
        return sum(len(c) + len(t) - 1 for c, t in zip(self.children, self.own, strict=True) if c or t)


def mine(sets: list[set[int]], least: int = SHARED) -> Sharing:
    """The graph of some term sets. Sets are bit masks over the terms that two of them have, and a shared set is itself open
    to sharing. Each step takes the pair with the largest intersection and lets every set that holds all of it use it."""
    often = Counter(t for s in sets for t in s)
    bit = {t: i for i, t in enumerate(sorted(t for t, n in often.items() if n > 1))}
    term = list(bit)
    masks = [sum(1 << bit[t] for t in s if t in bit) for s in sets]
    children: list[list[int]] = [[] for _ in sets]
    # Each set's best partner among the earlier ones; only where a mask changed it is looked for anew.
    best: list[tuple[int, int]] = [(0, -1)] * len(sets)

    def look(k: int) -> None:
        best[k] = max(((masks[k] & masks[j]).bit_count(), -j) for j in range(k)) if k else (0, 0)

    for k in range(len(sets)):
        look(k)
    while True:
        n, k = max(((b[0], -i) for i, b in enumerate(best)), default=(0, 0))
        if n < least:
            break
        k = -k
        shared, new = masks[k] & masks[-best[k][1]], len(masks)
        changed = {i for i, m in enumerate(masks) if m & shared == shared}
        for i in changed:
            masks[i] ^= shared
            children[i].append(new)
        masks.append(shared)
        children.append([])
        best.append((0, 0))
        for i in range(len(masks)):
            if i in changed or i == new or -best[i][1] in changed:
                look(i)
    # A set that one other alone uses saves nothing: it can't be, as two sets gave rise to it.
    own = [[t for t in sorted(s) if t not in bit] for s in sets] + [[] for _ in masks[len(sets) :]]
    for k, m in enumerate(masks):
        while m:
            low = m & -m
            own[k].append(term[low.bit_length() - 1])
            m ^= low
    return Sharing(len(sets), children, own)


class Batch:
    """Postings of some documents: for each term the places of the documents that hold it, and its impact in them."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: list[int], n_docs: int, n_terms: int, weight: np.ndarray) -> None:
        self.size = len(terms)
        # A document's m by numbers of any size; the rest fits 64 bits while tf * 10 ** 9 and w * 10 ** 6 do.
        m = np.array([50 + 50 * n * n_docs // max(1, n_terms) for n in lengths], np.int64)
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(self.size), [len(t) for t in terms])
        tf = (np.concatenate(counts) if counts else term).astype(np.int64)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        found, start = np.unique(term, return_index=True)
        at = [*start.tolist(), len(term)]
        self.span = dict(zip(found.tolist(), zip(at[:-1], at[1:], strict=True), strict=True))

    def scores(self, graph: Sharing) -> np.ndarray:
        """A row of scores for each item. Shared sets come after what uses them, so sums are made from the end."""
        total = np.zeros((len(graph.own), self.size), np.int64)
        for k in range(len(graph.own) - 1, -1, -1):
            row = total[k]
            for t in graph.own[k]:
                if t in self.span:
                    a, b = self.span[t]
                    row[self.doc[a:b]] += self.impact[a:b]
            for c in graph.children[k]:
                row += total[c]
        return total[: graph.items]


class Best:
    """The k best documents of an item so far: highest score, then smallest id, rows without id last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        least = max(int(self.score[-1]), 1) if len(self.score) == self.k else 1
        at = np.flatnonzero(score >= least)
        if len(at) > 4 * self.k:  # whatever is below the k-th is not among the best
            at = at[score[at] >= np.partition(score[at], -self.k)[-self.k]]
        if len(at):
            s, d, n = np.append(self.score, score[at]), np.append(self.doc, doc[at]), np.append(self.none, none[at])
            order = np.lexsort((d, n, -s))[: self.k]
            self.score, self.doc, self.none = s[order], d[order], n[order]


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the different terms of each item. Rows of one id are one item."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))

    def work(cols: list[list]) -> Iterator[tuple]:
        for i, t in zip(*cols, strict=True):
            for term in sorted(set(terms_of(t))):
                yield i, term

    return map_rows(rows, work, f"item_id {items.schema[item_id].dataType.simpleString()}, term binary").distinct()


def _groups(rows: Iterable, most: int, vocabulary: int) -> Iterator[list[tuple]]:
    """Items, each with its terms, in groups for one pass over the documents; the last item of a group may pass the bound."""
    group: list[tuple] = []
    seen: set[bytes] = set()
    for r in rows:
        group.append((r.item_id, [bytes(t) for t in r.terms]))
        seen.update(group[-1][1])
        if len(seen) >= vocabulary or len(group) >= most:
            yield group
            group, seen = [], set()
    if group:
        yield group


def _counted(docs: DataFrame, doc_id: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): a document's number of terms, and which of the items' terms it holds how often. Documents
    without any term are left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(number)  # at most about VOCABULARY terms

    def work(cols: list[list]) -> Iterator[tuple]:
        known = shared.value
        for i, t in zip(*cols, strict=True):
            terms = terms_of(t)
            if terms:
                held = Counter(map(known.get, terms))
                held.pop(None, None)
                yield i, len(terms), list(held), list(held.values())

    return map_rows(rows, work, "doc_id long, n long, term array<int>, tf array<int>")


def _ranked(counted: DataFrame, groups: list[tuple[list, Sharing]], weight: np.ndarray, totals: tuple[int, int], best: int, id_type: str) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast((groups, weight))
    schema = f"item_id {id_type}, doc_id long, score long"
    names, types = arrow_schema(counted, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, w = shared.value
        found = [[Best(best) for _ in ids] for ids, _ in plans]
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                b = whole.slice(at, DOCS)
                none = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum([0, *(len(t) for t in b.column("term"))])
                flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "tf")]
                parts = [[f[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)] for f in flat]
                held = Batch(*parts, b.column("n").to_pylist(), *totals, w)
                for (_, graph), bests in zip(plans, found, strict=True):
                    for top, score in zip(bests, held.scores(graph), strict=True):
                        top.add(score, ids, none)
        for (items, _), bests in zip(plans, found, strict=True):
            for item, top in zip(items, bests, strict=True):
                if len(top.score):
                    columns = [pa.array([item] * len(top.score), types[0]), pa.array(top.doc, mask=top.none), pa.array(top.score)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(counted).mapInArrow(run, schema)


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the `best` documents of highest score above 0, equal scores by id.

    A term's weight falls with the number of documents that hold it, and its impact with the document's length; see
    README. Null texts, and texts without a term, have none: such documents don't count, such items have no rows. Rows of one
    item_id are one item, also those without id. Every row of docs is a document for itself; those without id are
    last among equals. Texts are read whole. Other columns are ignored. Without items or documents there are no rows.
    Items beyond VOCABULARY different terms are searched in several passes over the documents.
    """
    id_type = items.schema[item_id].dataType.simpleString()
    spark = docs.sparkSession
    sets = item_terms(items, item_id, text).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    # Items whose commonest terms are alike come together, so that they are mined together.
    out: list[DataFrame] = []
    for group in _groups(stored(sets).orderBy("item_id").toLocalIterator(), ITEMS, VOCABULARY):
        number = {t: i for i, t in enumerate(sorted({t for _, terms in group for t in terms}))}
        counted = stored(_counted(docs, doc_id, text, number))
        n_docs, n_terms = (int(x or 0) for x in counted.agg(F.count("*"), F.sum("n")).first())
        held = counted.select(F.explode("term").alias("t")).groupBy("t").count().collect()  # a number for each term of the group
        df = np.zeros(len(number), np.int64)
        df[[r.t for r in held]] = [r["count"] for r in held]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        wanted = [(i, {number[t] for t in terms}) for i, terms in group]
        alike = sorted(wanted, key=lambda w: sorted(w[1], key=lambda t: (weight[t], t)))
        plans = []
        for at in range(0, len(alike), GROUP):
            some = alike[at : at + GROUP]
            # Terms that no document holds, or that weigh nothing, don't take part.
            plans.append(([i for i, _ in some], mine([{t for t in s if df[t] and weight[t]} for _, s in some])))
        out.append(_ranked(counted, plans, weight, (n_docs, n_terms), best, id_type))
    if not out:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out[0].withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
