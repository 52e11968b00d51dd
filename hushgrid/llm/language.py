"""Languages of a document as a mixture.

Each language is a distribution over character trigrams (hashed into BUCKETS) learned from labelled documents.
Expectation-maximisation estimates the shares of a set of languages in a document. The set grows from the single
likeliest language by the one that the likelihood gains most from, as long as the gain exceeds a penalty for each
language more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import held_out, map_rows, small_batches

#: Labelled documents of a language that the model is fitted on (about), and buckets.
SAMPLE, BUCKETS = 5_000, 1 << 15
#: Languages whose shares of the sample are sent to all tasks.
LANGUAGES = 10_000
#: Steps of expectation-maximisation, and the penalty for a language more, times the log of the trigrams.
STEPS, PENALTY = 12, 1.5
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point of the basic plane: the small letter, or a blank if it is none."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of letters; whatever isn't a letter is a blank, and blanks in a row are one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(points < 0x10000, _letters()[np.minimum(points, 0xFFFF)], points)
    c = np.concatenate((np.full(1, 32, np.uint32), c, np.full(1, 32, np.uint32)))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(17)


class Model:
    """Names of the languages, and the log probabilities of buckets by language: those counted, sorted by bucket, and
    one for all that a language lacks."""

    def __init__(self, packed: list[tuple[str, float, bytes, bytes]]) -> None:
        """packed: of each language its name, total, buckets (uint16) and their log probabilities (float32). Nothing is
        unpacked before it is used, in a task."""
        self.packed = sorted(packed)
        self.names = [p[0] for p in self.packed]

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Languages and values in order of buckets, where each bucket begins, and the values of what is lacking."""
        buckets = [np.frombuffer(p[2], np.uint16) for p in self.packed]
        at = np.argsort(np.concatenate(buckets), kind="stable").astype(np.uint32)
        lang = np.repeat(np.arange(len(buckets), dtype=np.uint32), [len(b) for b in buckets])[at]
        value = np.concatenate([np.frombuffer(p[3], np.float32) for p in self.packed])[at]
        n = np.bincount(np.concatenate(buckets), minlength=BUCKETS)
        return lang, value, np.concatenate(([0], np.cumsum(n))), np.log(0.1 / np.array([p[1] for p in self.packed])).astype(np.float32)

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "names": self.names}

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """Log probabilities (bucket x language)."""
        lang, value, begin, lacking = self._table
        out = np.tile(lacking.astype(np.float64), (len(buckets), 1))
        size = begin[buckets + 1] - begin[buckets]
        where = np.repeat(begin[buckets] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(buckets)), size), lang[where]] = value[where]
        return out

    def mixture(self, text: str | None) -> dict[str, float]:
        """Shares of the languages of a text, largest first; empty if it has no letter or nothing was learned."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return {}
        n = np.bincount(trigrams(text), minlength=BUCKETS)
        at = np.flatnonzero(n)
        n = n[at].astype(np.float64)
        logp = self.rows(at)
        top = logp.max(axis=1, keepdims=True)
        p = np.exp(logp - top)
        likelihood = n @ (logp - top)
        chosen = [int(likelihood.argmax())]
        share, best = np.ones(1), float(likelihood.max())
        penalty = PENALTY * np.log(max(2.0, n.sum()))
        while len(chosen) < len(self.names):
            gain = (n / (p[:, chosen] @ share)) @ p
            gain[chosen] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= n.sum():  # no small share of it raises the likelihood
                break
            q = p[:, [*chosen, new]]
            s = np.append(share * 0.9, 0.1)
            for _ in range(STEPS):
                s = s * ((n / (q @ s)) @ q) / n.sum()
            value = float(n @ np.log(q @ s))
            if value - best <= penalty:
                break
            chosen, share, best = [*chosen, new], s, value
        return {self.names[chosen[k]]: float(share[k]) for k in np.argsort(-share, kind="stable")}


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from text and lang of about SAMPLE documents of each language outside the held-out fold, picked by the
    hash of id and text. Languages without a trigram are left out."""
    known = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    share = known.groupBy("lang").agg((F.lit(SAMPLE) / F.count("*")).alias("share"))
    few = share.limit(LANGUAGES + 1).collect()  # of more languages the shares are joined, not sent to all tasks
    share = F.broadcast(docs.sparkSession.createDataFrame(few, share.schema)) if len(few) <= LANGUAGES else share
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / (1 << 40)
    picked = known.join(share, "lang").where(drawn < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    held[name] = held.get(name, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
        for name, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = small_batches(picked.select("lang", "text")).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def pack(table: pa.Table) -> pa.Table:  # at most BUCKETS rows: one language
        n, bucket = table.column("n").to_numpy(), table.column("bucket").to_numpy()
        at, total = np.argsort(bucket), float(n.sum() + 0.1 * BUCKETS)
        value = np.log((n[at] + 0.1) / total).astype(np.float32)
        return pa.table({"lang": table.column("lang").slice(0, 1), "total": [total], "bucket": [bucket[at].astype(np.uint16).tobytes()], "value": [value.tobytes()]})

    packed = rows.groupBy("lang").applyInArrow(pack, "lang string, total double, bucket binary, value binary")
    return Model([(r.lang, r.total, bytes(r.bucket), bytes(r.value)) for r in packed.collect()])  # six bytes a bucket and language


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred (largest share), score (that share), and mixture, the
    shares of the selected languages.

    Null texts and texts without a letter are `und` with score 0. Repeated rows come out alike; a row without
    doc_id counts as held out. Rows of null lang are predicted like others. A text is counted whole, however long; of
    equally likely languages the first name is taken. Other columns are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id, text, lang))

    def work(cols: list[list]) -> Iterator[tuple]:
        for i, t in zip(*cols, strict=True):
            found = list(shared.value.mixture(t).items())
            yield i, *(found[0] if found else (NONE, 0.0)), [{"lang": k, "share": v} for k, v in found]

    found = map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, lang_pred string, score double, mixture array<struct<lang string, share double>>")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.least(F.lit(1.0), "score").alias("score"), "mixture")
