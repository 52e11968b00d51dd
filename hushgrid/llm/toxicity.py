"""Toxic passages by maximum-scoring segment search.

Words score by their log-odds between toxic and clean labelled documents under a Dirichlet prior. A linear-time scan
(Ruzzo and Tompa 1999) finds all maximal scoring segments of a text. Extreme-value statistics (Karlin and Altschul
1990) turn a segment's score into the number of such segments that chance would give in a text of that length; a
text is scored by its significant segments.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import stored
from .batches import held_out, map_rows, small_batches

#: Labelled documents that the model is fitted on, picked by the hash of their id. They bound the features too.
SAMPLE = 20_000
#: Characters of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Weight of the Dirichlet prior as a share of the smaller class, and deviations from zero that a feature's log-odds
#: needs and is lowered by. Too light a prior would leave words that one class never has with a large variance.
PRIOR, DEVIATIONS, SURE = 0.5, 3.0, 2.0
#: What every word costs a segment, and the most that one word can bring.
DRIFT, MOST = 0.25, 6.0
#: Expected chance segments below which one is significant.
SIGNIFICANT = 0.05

_word = re.compile(r"\w+").findall


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in order; linear time.

    Runs of words that don't score are passed over by their sum, so the scan takes a step for each word that does.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[list] = []  # [start, end, sum before, sum up to the end, nearest earlier one of a smaller sum before]
    for at in np.flatnonzero(scores > 0).tolist():
        new = [at, at + 1, total[at], total[at + 1], -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            new[4] = j
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new[0], new[2] = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, float(r - b)) for s, e, b, r, _ in held]


@dataclass
class Model:
    """Log-odds and deviations by feature, the extreme-value parameters, and the scale of the final score."""

    odds: dict[str, tuple[float, float]] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    shift: float = -2.0

    def word(self, word: str) -> float:
        """The score of a word: the largest of its features' log-odds, each taken SURE deviations lower, less the drift."""
        best = max((o - SURE * o / z for o, z in (self.odds[f] for f in features(word) if f in self.odds)), default=0.0)
        return min(best, MOST) - DRIFT

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed normalised scores (in nats over chance) of the significant segments, and these."""
        if not len(scores) or not (scores > 0).any():
            return 0.0, []
        over = math.log(self.k * len(scores))
        found = [(s, e, self.lam * x - over) for s, e, x in segments(scores)]
        found = [f for f in found if math.exp(-f[2]) < SIGNIFICANT]
        return sum(f[2] for f in found), found

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.shift))))


class Scorer(dict):
    """Word scores under a model, remembered for at most `most` words."""

    def __init__(self, model: Model, most: int = 100_000) -> None:
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = s = self.model.word(word)
        return s

    def of(self, text: str | None) -> np.ndarray:
        words = _word(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), float, len(words))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from at most SAMPLE labelled documents outside the held-out fold; with several labels for a document
    the largest counts. Without labels of both kinds no word scores, and every text is clean."""
    own = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # The labels broadcast are at most SAMPLE rows of two numbers. Copies of a text count once, as do a text's
    # repetitions of a word: both would pass for evidence that there isn't.
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(own), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    sample = stored(sample)  # read three times

    def tally(cols: list[list]) -> Iterator[tuple]:
        of = {0: Counter(), 1: Counter()}
        for toxic, t in zip(*cols, strict=True):
            of[int(toxic > 0)].update({f for w in set(_word((t or "").lower())) for f in features(w)})
        for f in of[0].keys() | of[1].keys():
            yield f, of[1][f], of[0][f]

    counts = map_rows(sample, tally, "feature string, toxic long, clean long", 500).groupBy("feature").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))
    counts = stored(counts)
    words = counts.where(~F.col("feature").endswith("*")).agg(F.sum("y1"), F.sum("y0")).first()
    n1, n0 = float(words[0] or 0), float(words[1] or 0)
    if not n1 or not n0:
        return Model()
    weight = PRIOR * min(n1, n0)
    prior = weight * (F.col("y1") + F.col("y0")) / (n1 + n0)
    odds = lambda y, n: F.log((y + prior) / (n + weight - y - prior))
    scored = counts.withColumn("odds", odds(F.col("y1"), n1) - odds(F.col("y0"), n0)).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior)))
    sure = scored.where(F.abs("z") >= DEVIATIONS).select("feature", "odds", "z")
    # So sure a feature stands in several of the sample's texts, so these are far fewer than the sample's words.
    return calibrated(Model({r.feature: (r.odds, r.z) for r in sure.collect()}), sample)


def extreme_value(n: float, islands: float, total: float) -> tuple[float, float]:
    """lambda and K of Karlin and Altschul (1990), so that about K * n * exp(-lambda * x) segments of n words reach x by
    chance, from the maximal segments ("islands") of texts without a signal: their words, the segments' number and their
    summed scores. The likeliest lambda of exponential scores is one over their mean (Altschul and others 2001)."""
    if not islands or not total:
        return 1.0, 1 / max(1.0, n)
    return islands / total, islands / n


def calibrated(model: Model, sample: DataFrame) -> Model:
    """Sets lam and k from the segments of clean documents, then the logistic scale from all of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def spread(cols: list[list]) -> Iterator[tuple]:
        of = Scorer(shared.value)
        for toxic, t in zip(*cols, strict=True):
            if not toxic:
                scores = of.of(t)
                found = segments(scores)
                yield len(scores), len(found), sum(x for _, _, x in found)

    seen = map_rows(sample, spread, "n long, islands long, total double").agg(F.sum("n"), F.sum("islands"), F.sum("total")).first()
    model.lam, model.k = extreme_value(*(float(x or 0) for x in seen))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def weigh(cols: list[list]) -> Iterator[tuple]:
        of = Scorer(shared.value)
        return ((float(toxic > 0), math.log1p(shared.value.evidence(of.of(t))[0])) for toxic, t in zip(*cols, strict=True))

    known = np.array(map_rows(sample, weigh, "y double, x double").collect()).reshape(-1, 2)  # at most SAMPLE pairs
    y, x = known[:, 0], np.stack([known[:, 1], np.ones(len(known))], 1)
    w = np.array([1.0, -2.0])
    for _ in range(50):  # Newton steps of a logistic regression with a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (q - y) + 1e-3 * w)
    if np.isfinite(w).all() and w[0] > 0:
        model.slope, model.shift = float(w[0]), float(w[1])
    return model


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, and passages: the significant segments as (first word, word after the
    last, expected number by chance). Null and empty texts score like texts without a toxic word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(cols: list[list]) -> Iterator[tuple]:
        of = Scorer(shared.value)
        for i, t in zip(*cols, strict=True):
            evidence, found = shared.value.evidence(of.of(t))
            yield i, shared.value.score(evidence), [{"first": s, "end": e, "by_chance": math.exp(-x)} for s, e, x in found]

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, score double, passages array<struct<first int, end int, by_chance double>>")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row of docs; the model learns from the other folds.

    Rows without doc_id count as held out. Repeated rows score alike; null and empty texts as texts without a toxic word.
    A text is scanned whole, in linear time. Other columns are ignored. An empty table gives no rows.
    """
    scored = score_documents(docs, fit(docs, labels, doc_id, text), doc_id, text)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that don't score as toxic. Null and empty texts stay, repeated rows are judged alike, a
    text is scored whole, however long, and an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([shared.value.score(shared.value.evidence(of.of(t))[0]) for t in texts], dtype=float)

    return small_batches(docs).where(score(F.col(text)) < 0.5)
