"""Quality rules: counts of words, signs and repetitions, and n-gram perplexity.

The language model is a modified Kneser-Ney model of order SPAN over characters as they are, one for each language.
Spark counts the n-grams, combined on the map side, and estimates the model by aggregations and joins over tables of
n-grams, so it grows with the corpus and no task or driver holds a language while it is made. The model is counted from
every text with at most one sign in ten words (SIGN_SHARE, a published rule for prose); every text is judged. Counted
from all, it would find the commonest kinds of disorder quite usual. An n-gram that only one text has is not stored: it
backs off to the longest ending that other texts have too, or no text would look disordered to a model counted from it.

The model is stored as a sorted array of n-gram hashes beside costs and back-off weights. Up to BROADCAST n-grams every
worker gets the whole array; a larger model stays a table, and each part of the documents joins its own distinct n-grams
to it. Both ways give the same costs. A document is rejected when its perplexity a character lies outside its language's
band: too high is disorder, too low is repetition. A band is set from the distribution of all documents of that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..plans.shared import stored
from .batches import mix, small_batches, words_of

#: Characters of an n-gram; characters that are worked on at once; new n-grams that wait to be sorted in; n-grams that a
#: task counts before it hands them on.
SPAN, AT_ONCE, WAITING, VOCABULARY = 4, 1 << 16, 1 << 18, 1 << 21
#: Most n-grams of a model that workers get whole (16 bytes each), and characters of a part of the documents beyond that.
BROADCAST, PART = 1 << 22, 1 << 24
#: Rows about languages that tasks get whole.
LANGUAGES = 100_000
#: Words that a text needs, and the share of repeated ones that it may have: fixed by the contract.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Signs that count as symbols: fixed by the contract.
SIGNS = "#*$%&|<>"
#: Signs a word up to which the model is counted from a text.
SIGN_SHARE = 0.1
#: A band reaches this many robust deviations from the language's median log perplexity, and at least so far down and up.
#: Passages in another language raise the perplexity of sound texts, so it may rise further than fall.
REACH, LEAST_DOWN, LEAST_UP = 5.0, 0.3, 0.6
#: Steps of log perplexity that a band is set in.
GRAIN = 1000
#: Cost of a character in a language without any counted text: one of all code points.
UNKNOWN = float(np.log(0x110000))

_TOP = np.uint64((1 << 64) - 1)
_odd = mix(np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_order = mix(np.arange(101, SPAN + 102, dtype=np.uint64))


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    again, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\v\f\r"):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        once, twice = set(), set()
        for w in windows:
            (twice if w in once else once).add(w)
        upto = 0  # words before this place are counted
        for k, w in enumerate(windows):
            if w in twice:
                repeated += k + 3 - max(k, upto)
                upto = k + 3
    return len(words), chars, sum(map(text.count, SIGNS)), again, repeated


def counted(text: str) -> bool:
    """Whether the model is counted from a text."""
    signs = sum(map(text.count, SIGNS))
    return not signs or signs <= SIGN_SHARE * len(words_of(text))


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Of each code point itself; white space is a blank, and what Spark's strings can't hold is U+FFFD."""
    c = np.arange(0x110000, dtype=np.uint32)
    c[[*range(9, 14), 0x85, 0xA0]] = 32
    c[0] = c[0xD800:0xE000] = 0xFFFD
    return c


def points(text: str) -> np.ndarray:
    """Folded code points with SPAN - 1 blanks in front."""
    return _folded()[np.frombuffer((" " * (SPAN - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)]


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


class Stretch:
    """Some texts' code points end to end, each text behind SPAN - 1 characters that aren't its own (see points), and
    the hashes of the n-grams that end at each own character."""

    def __init__(self, texts: list[np.ndarray], langs: list[str]) -> None:
        self.points = np.concatenate(texts).astype(np.uint64)
        size = np.array([len(t) for t in texts]) - (SPAN - 1)
        begin = np.cumsum(size + SPAN - 1) - size
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        self.at = np.arange(len(self.text)) + np.repeat(begin - (np.cumsum(size) - size), size)
        self.seed = np.array([_seed(x) for x in langs], np.uint64)[self.text]

    def keys(self, order: int, which: np.ndarray | None = None, back: int = 0) -> np.ndarray:
        """Hashes of the n-grams of an order that end at the characters, or `back` characters before them."""
        if which is None:
            h = np.zeros(len(self.points), np.uint64)
            for k in range(order):
                h[k + back :] += self.points[: len(h) - k - back] * _odd[k]
            h = h[self.at]
        else:
            at, h = self.at[which] - back, np.zeros(len(which), np.uint64)
            for k in range(order):
                h += self.points[at - k] * _odd[k]
        return mix(h ^ (self.seed if which is None else self.seed[which]) ^ _order[order])


class HashArray:
    """A sorted array of hashes with a directory of their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, min(22, len(keys).bit_length() + 1))
        self.keys, self.shift = np.append(keys, _TOP), np.uint64(64 - bits)
        size = np.bincount(keys >> self.shift, minlength=1 << bits)
        self.first = (np.cumsum(size) - size).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there."""
        at = self.first[wanted >> self.shift]
        there = self.keys[at]
        behind = np.flatnonzero(there < wanted)
        while len(behind):
            at[behind] += 1
            there[behind] = found = self.keys[at[behind]]
            behind = behind[found < wanted[behind]]
        return at, there == wanted


class Vocabulary:
    """Counts of a task's n-grams of the highest order: sorted hashes, and for each its language, characters, number of
    occurrences, and the text that has it, or 0 if there are several. New n-grams wait until there are many."""

    def __init__(self) -> None:
        self.table = HashArray(np.zeros(0, np.uint64))
        self.n, self.tag = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.lang, self.grams = np.zeros(0, object), np.zeros((0, SPAN), np.uint32)
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def __len__(self) -> int:
        return len(self.n) + self.waiting

    def add(self, s: Stretch, langs: list[str], tags: np.ndarray) -> None:
        keys, tag = s.keys(SPAN), tags[s.text]
        at, known = self.table.find(keys)
        hit, new = at[known], np.flatnonzero(~known)
        self.n += np.bincount(hit, minlength=len(self.n))
        self.tag[hit[self.tag[hit] != tag[known]]] = 0
        if len(new):
            self.new.append((keys[new], tag[new], np.array(langs, object)[s.text[new]], s.points[s.at[new][:, None] + np.arange(1 - SPAN, 1)].astype(np.uint32)))
            self.waiting += len(new)
            if self.waiting >= WAITING:
                self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        keys, tag, lang, grams = (np.concatenate(x) for x in zip(*self.new, strict=True))
        at = np.argsort(keys)
        cut = np.flatnonzero(np.concatenate(([True], np.diff(keys[at]) != 0)))
        least = np.minimum.reduceat(tag[at], cut)
        tag = np.where(least == np.maximum.reduceat(tag[at], cut), least, 0)
        n, first = np.diff(np.append(cut, len(at))), at[cut]
        keys = np.concatenate((self.table.keys[:-1], keys[first]))
        order = np.argsort(keys, kind="stable")
        self.n, self.tag, self.lang, self.grams = (np.concatenate(x)[order] for x in ((self.n, n), (self.tag, tag), (self.lang, lang[first]), (self.grams, grams[first])))
        self.table, self.new, self.waiting = HashArray(keys[order]), [], 0

    def rows(self) -> pa.RecordBatch:
        self.merge()
        grams = np.ascontiguousarray(self.grams).view(f"<U{SPAN}").ravel()
        return pa.RecordBatch.from_arrays([pa.array(self.lang.tolist(), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(self.n), pa.array(self.tag)], names=["lang", "gram", "n", "tag"])


def _pieces(texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, piece) of at most AT_ONCE own characters; a later piece has the former's end in front."""
    for k, t in enumerate(texts):
        for at in range(0, len(t) - SPAN + 1, AT_ONCE):
            yield k, t[at : at + AT_ONCE + SPAN - 1]


def _stretches(texts: list[np.ndarray], langs: list[str]) -> Iterator[tuple[np.ndarray, Stretch]]:
    """Stretches of about AT_ONCE characters at most twice, and the numbers of the texts in each."""
    held, size = [], 0
    for k, piece in _pieces(texts):
        held.append((k, piece))
        size += len(piece)
        if size >= AT_ONCE:
            yield np.array([x for x, _ in held]), Stretch([p for _, p in held], [langs[x] for x, _ in held])
            held, size = [], 0
    if held:
        yield np.array([x for x, _ in held]), Stretch([p for _, p in held], [langs[x] for x, _ in held])


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n, tag) over the counted texts of docs (lang, text): tag is the hash of the text if but one text has
    the n-gram, else 0. Equal texts are one text, but every copy's n-grams count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Vocabulary()
        for b in batches:
            rows = [(g, t) for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and counted(t)]
            langs = [g for g, _ in rows]
            tags = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 33 | 1 for _, t in rows], np.int32)
            for k, s in _stretches([points(t) for _, t in rows], langs):
                found.add(s, [langs[x] for x in k], tags[k])
                if len(found) >= VOCABULARY:
                    yield found.rows()
                    found = Vocabulary()
        yield found.rows()

    rows = small_batches(docs.select("lang", "text")).mapInArrow(run, "lang string, gram string, n long, tag int")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"), _tag())


def _tag():
    return F.when(F.min("tag") == F.max("tag"), F.min("tag")).otherwise(F.lit(0)).alias("tag")


def _by_language(rows: DataFrame) -> DataFrame:
    """Some rows for each language, to be joined to many: sent to all tasks if they are at most LANGUAGES, as a join by
    language would bring a language's rows into one task."""
    rows = stored(rows)
    return F.broadcast(rows) if rows.count() <= LANGUAGES else rows


def estimate(counts: DataFrame) -> DataFrame:
    """(lang, gram, cost, back) of the n-grams of all orders that several texts have, and of the empty one for each
    language: the cost of the last character after the others, by modified Kneser-Ney (Chen and Goodman 1998), and what a
    character more costs that never followed. Orders below the highest count the different characters that go before.

    All orders go through each step together, told apart by the length of the n-gram."""
    size = F.length("gram")
    longer = counts.select("lang", F.explode(F.sequence(F.lit(2), F.lit(SPAN))).alias("k"), "gram", "n", "tag")
    longer = longer.select("lang", F.expr("substring(gram, 1 - k + length(gram))").alias("gram"), F.when(F.col("k") == SPAN, F.col("n")).otherwise(0).alias("n"), "tag")
    longer = longer.groupBy("lang", "gram").agg(F.sum("n").alias("c"), _tag())
    shorter = longer.select("lang", F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("c"), "tag")
    rows = stored(shorter.unionByName(longer.where(size == SPAN)).groupBy("lang", "gram").agg(F.sum("c").alias("c"), _tag()))
    n1, n2, n3, n4 = (F.greatest(F.lit(1), F.count_if(F.col("c") == j)) for j in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [F.greatest(F.lit(0.1), F.least(F.lit(float(j)), j - (j + 1) * y * more / less)).alias(f"d{j}") for j, (less, more) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    discounts = _by_language(rows.groupBy("lang", size.alias("k")).agg(*d))
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("k", size).join(discounts, ["lang", "k"]).withColumn("cut", F.least(cut, F.col("c"))).withColumn("context", F.expr("substring(gram, 1, k - 1)"))
    # Sums by context are combined on the map side. A context's length is the order but one.
    sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("cut").alias("cuts"))
    sums = stored(sums.select("lang", "context", "total", (F.col("cuts") / F.col("total")).alias("free")))
    parts = rows.join(sums, ["lang", "context"]).select("lang", "gram", "k", ((F.col("c") - F.col("cut")) / F.col("total")).alias("own"), "free", "tag")
    parts = stored(parts)
    # p(gram) = own + free * p(gram without its first character), down to one of all characters and an unknown one.
    base = _by_language(parts.where("k = 1").groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p0")))
    known = parts.where("tag = 0")
    ends = known.select("lang", F.col("gram").alias("whole"), F.explode(F.expr("transform(sequence(1, k), j -> substring(gram, j))")).alias("gram"))
    of_order = [F.max(F.when(F.col("k") == j, F.col(c))).alias(f"{c}{j}") for j in range(1, SPAN + 1) for c in ("own", "free")]
    chain = ends.join(parts.select("lang", "gram", "k", "own", "free"), ["lang", "gram"]).groupBy("lang", "whole").agg(*of_order)
    p = F.col("p0")
    for j in range(1, SPAN + 1):
        p = F.coalesce(f"own{j}", F.lit(0.0)) + F.coalesce(f"free{j}", F.lit(1.0)) * p
    costs = chain.join(base, "lang").select("lang", F.col("whole").alias("gram"), (-F.log(p)).alias("cost"))
    costs = costs.unionByName(base.select("lang", F.lit("").alias("gram"), (-F.log("p0")).alias("cost")))
    backs = sums.select("lang", F.col("context").alias("gram"), (-F.log("free")).alias("back"))
    return costs.join(backs, ["lang", "gram"], "left").select("lang", "gram", "cost", F.coalesce("back", F.lit(0.0)).alias("back"))


def keyed(model: DataFrame) -> DataFrame:
    """(key, cost, back): an estimated model by the hashes of its n-grams."""

    @F.pandas_udf("long")
    def key(langs: pd.Series, grams: pd.Series) -> pd.Series:
        seeds = {g: _seed(g) for g in langs.unique()}
        seed = np.array([seeds[g] for g in langs], np.uint64)
        size = grams.str.len().to_numpy(np.int64)
        c = np.frombuffer("".join(grams.str.rjust(SPAN)).encode("utf-32-le"), np.uint32).reshape(-1, SPAN)[:, ::-1]
        c = np.where(np.arange(SPAN) < size[:, None], c, 0).astype(np.uint64)
        return pd.Series(mix((c * _odd).sum(axis=1, dtype=np.uint64) ^ seed ^ _order[size]).view(np.int64))

    return model.select(key("lang", "gram").alias("key"), F.col("cost").cast("float").alias("cost"), F.col("back").cast("float").alias("back"))


def packed(model: DataFrame) -> DataFrame:
    """(keys, costs, backs): a keyed model in arrays of bytes, each sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one partition of a model of at most BROADCAST rows
        if held:
            t = pa.Table.from_batches(held)
            at = np.argsort(t.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([t.column(c).to_numpy()[at].tobytes()], pa.binary()) for c in ("key", "cost", "back")], names=["keys", "costs", "backs"])

    return small_batches(model).mapInArrow(run, "keys binary, costs binary, backs binary")


class Costs:
    """Costs and back-off weights beside a sorted array of hashes."""

    def __init__(self, keys: np.ndarray, cost: np.ndarray, back: np.ndarray) -> None:
        keys = keys.view(np.uint64)
        at = np.argsort(keys)
        self.table, self.cost, self.back = HashArray(keys[at]), np.append(cost[at], np.float32(0)), np.append(back[at], np.float32(0))

    def of(self, s: Stretch) -> np.ndarray:
        """-log p of each character: the longest known n-gram's cost, after the back-off weights of longer contexts."""
        out, left = np.zeros(len(s.at)), np.arange(len(s.at))
        for k in range(SPAN, -1, -1):
            at, known = self.table.find(s.keys(k, left))
            out[left[known]] += self.cost[at[known]]
            left = left[~known]
            if k and len(left):
                at, known = self.table.find(s.keys(k - 1, left, 1))
                out[left[known]] += self.back[at[known]]
        out[left] = UNKNOWN
        return out


def mean_costs(model: Costs, texts: list[str | None], langs: list[str]) -> list[float | None]:
    """The log perplexity of a character of each text under its language's model; None for empty texts."""
    rows = [(k, points(t)) for k, t in enumerate(texts) if t]
    total = np.zeros(len(texts))
    for k, s in _stretches([p for _, p in rows], [langs[k] for k, _ in rows]):
        np.add.at(total, np.array([rows[x][0] for x in k]), np.bincount(s.text, model.of(s), len(k)))
    return [float(x) / len(t) if t else None for x, t in zip(total, texts, strict=True)]


MEASURES = "n_chars long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"
_names = [f.split()[0] for f in MEASURES.split(", ")]


def _measured(model: Costs, texts: list[str | None], langs: list[str]) -> pd.DataFrame:
    rows = [(len(t or ""), *counts(t), c) for t, c in zip(texts, mean_costs(model, texts, langs), strict=True)]
    return pd.DataFrame(rows, columns=_names).astype({n: "int64" for n in _names[:-1]} | {_names[-1]: "float64"})


def measure(docs: DataFrame) -> DataFrame:
    """docs (row, lang, text) with the struct m of MEASURES instead of text. The model is counted from docs."""
    model = stored(keyed(estimate(stored(count_grams(docs)))))
    if model.count() > BROADCAST:
        return _by_join(docs, model)
    rows = packed(model).collect()  # arrays of at most BROADCAST n-grams together
    arrays = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in rows)]) for c, kind in (("keys", np.int64), ("costs", np.float32), ("backs", np.float32)))
    shared = docs.sparkSession.sparkContext.broadcast(Costs(*arrays))

    @F.pandas_udf(MEASURES)
    def m(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs in batches:
            yield _measured(shared.value, texts.tolist(), langs.tolist())

    # Else a filter on m would be pushed below, with another run of it.
    return small_batches(docs).select("row", "lang", m.asNondeterministic()("text", "lang").alias("m"))


def _by_join(docs: DataFrame, model: DataFrame) -> DataFrame:
    """`measure` with a model of any size: a part of the documents meets the costs of its own n-grams and contexts."""
    parts = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // PART))
    # Copies of a row are dealt out by its other columns too; what is asked for and what is scored agree on the row alone.
    docs = docs.withColumn("part", F.pmod(F.xxhash64("row", "text"), F.lit(parts)).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, langs, texts = (b.column(k).to_pylist() for k in range(3))
            rows = sorted((p, g, t) for p, g, t in zip(part, langs, texts, strict=True) if t)
            for p in sorted({p for p, _, _ in rows}):
                own = [(g, t) for q, g, t in rows if q == p]
                for _, s in _stretches([points(t) for _, t in own], [g for g, _ in own]):
                    keys = np.unique(np.concatenate([s.keys(k) for k in range(SPAN + 1)] + [s.keys(k, back=1) for k in range(SPAN)])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), p, np.int32)), pa.array(keys)], names=["part", "key"])

    asked = small_batches(docs.select("part", "lang", "text").repartition(int(parts), "part")).mapInArrow(ask, "part int, key long")
    costs = asked.distinct().join(model, "key").select("part", "key", "cost", "back")
    schema = docs.select("row", "lang").schema.add("m", StructType.fromDDL(MEASURES))

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        own = Costs(*(found.column(c).to_numpy() for c in ("key", "cost", "back")))
        out = [_measured(own, *(rows.column(c).slice(at, 1000).to_pylist() for c in ("text", "lang"))) for at in range(0, rows.num_rows, 1000)]
        m = pa.Table.from_pandas(pd.concat(out), preserve_index=False)
        return pa.table([rows.column("row"), rows.column("lang"), pa.StructArray.from_arrays([m.column(n).combine_chunks() for n in _names], names=_names)], names=["row", "lang", "m"])

    return docs.select("part", "row", "lang", "text").groupBy("part").cogroup(small_batches(costs).groupBy("part")).applyInArrow(score, schema)


def _ready(docs: DataFrame, row, text: str, lang: str) -> DataFrame:
    return docs.select(row.alias("row"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))


def _base_failed():
    return (F.col("m.n_words") < LEAST_WORDS) | (100 * F.col("m.n_repeat_words") > 100 * MOST_REPEATED * F.col("m.n_words"))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high) of log perplexity, from the exact quartiles, to a GRAIN-th, of all of scored (lang, m): the
    median and robust deviations."""
    step = scored.where("m.log_perplexity IS NOT NULL").groupBy("lang", F.round(F.col("m.log_perplexity") * GRAIN).cast("long").alias("step")).agg(F.count("*").alias("n"))
    # As many rows for a language as there are different steps: some thousands at most, whatever the corpus.
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    ranked = step.withColumn("upto", upto / whole)
    q = [F.min(F.when(F.col("upto") >= x, F.col("step") / GRAIN)) for x in (0.25, 0.5, 0.75)]
    wide = REACH * 0.7413 * (q[2] - q[0])
    return ranked.groupBy("lang").agg((q[1] - F.greatest(F.lit(LEAST_DOWN), wide)).alias("low"), (q[1] + F.greatest(F.lit(LEAST_UP), wide)).alias("high"))


def _inside():
    return F.coalesce(F.col("m.log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, and perplexity with its band's lower and upper ends.

    Null and empty texts have no words, fail the base rules and have no perplexity. Null and empty languages are one,
    with a model and a band like any other. Repeated rows are judged alike. A text of any length is measured whole, in
    pieces. Other columns are ignored. An empty table gives no rows.
    """
    scored = stored(measure(_ready(docs, F.struct(F.col(doc_id).alias("doc_id")), text, lang))).withColumn("base_failed", _base_failed())
    return scored.join(_by_language(bands(scored.where("NOT base_failed"))), "lang", "left").select(
        "row.doc_id", *(f"m.{n}" for n in _names[1:-1]), "base_failed", (~F.col("base_failed") & _inside()).alias("kept"),
        F.exp("m.log_perplexity").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"),
    )


def good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that `judge` would keep. Nulls, empties, repeats and an empty table as there."""
    # Measured once and written with the texts: the bands need all of them before the first row can go.
    passed = stored(measure(_ready(docs, F.struct(*docs.columns), text, lang)).where(~_base_failed()))
    return passed.join(_by_language(bands(passed)), "lang").where(_inside()).select("row.*")
