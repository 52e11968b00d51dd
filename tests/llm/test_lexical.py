"""Ranked search against a plain version in Python, on awkward rows, in groups, and the graph of shared sets."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from hushgrid.llm import lexical

from ..conftest import SF
from .conftest import LONG, ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, best):
    """{item_id: [(doc_id, score)]} of rows (doc_id, text) and (item_id, text)."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms, df = len(held), sum(h[2] for h in held), Counter(t for h in held for t in h[1])
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i].update(terms(t))
    out = {}
    for i, ts in wanted.items():
        found = []
        for d, tf, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in ts if t in tf)
            if score > 0:
                found.append((d, score))
        if found:
            out[i] = sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))[:best]
    return out


def ranked(got):
    out = defaultdict(dict)
    for r in got:
        assert r.rank not in out[r.item_id]
        out[r.item_id][r.rank] = r.doc_id, r.score
    return {i: [found[k] for k in range(1, len(found) + 1)] for i, found in out.items()}


def test_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert ranked(lexical.rank(docs, items).collect()) == want


@pytest.mark.parametrize("sizes", [(256, 16_384, 500_000, 2048), (2, 16_384, 500_000, 3), (1, 2, 500_000, 1), (256, 16_384, 5, 2048)])
def test_awkward(spark, docs, monkeypatch, sizes):
    """Nulls, empty and long texts, repeats and ties; groups, passes and batches of any size give the same."""
    for name, value in zip(("GROUP", "ITEMS", "VOCABULARY", "DOCS"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, value)
    asked = [
        (1, "The cat, THE mat"), (2, None), (3, ""), (4, "..."), (5, "ça VA 漢字"), (5, "cat same"), (6, "nowhere"), (None, "mat slept"), (7, "a b"), (8, "cat mat the on p1 p2 p3"), (9, LONG), (10, "p1 p2 p3 goes"),
        (11, "Ça va Élan"),
    ]
    items = spark.createDataFrame([(*r, "x", "x", "x") for r in asked], "item_id long, text string, doc_id string, term string, score string")
    for best in (2, 50):
        got = lexical.rank(docs, items, best)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert ranked(got.collect()) == plain([(r[0], r[1]) for r in ROWS], asked, best)


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "cat"), (2, None)], "item_id int, text string")
    assert lexical.rank(empty, items).count() == 0 and lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs, items.where("item_id = 2")).columns == ["item_id", "rank", "doc_id", "score"]
    assert {r.item_id for r in lexical.rank(docs, items).collect()} == {1}


def test_ids_of_text(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (3, "x"), (4, "y"), (5, "z")], "doc_id int, text string")
    items = spark.createDataFrame([("one", "a b"), ("two", "d")], "item_id string, text string")
    assert ranked(lexical.rank(docs, items).collect()) == plain([(1, "a b c"), (2, "b c d"), (3, "x"), (4, "y"), (5, "z")], [("one", "a b"), ("two", "d")], 50)


def test_graph_gives_back_the_sets():
    rnd = random.Random(5)
    for _ in range(60):
        common = [rnd.sample(range(60), rnd.randrange(2, 12)) for _ in range(4)]
        sets = [set(rnd.sample(range(80), rnd.randrange(0, 9))).union(*rnd.sample(common, rnd.randrange(0, 4))) for _ in range(rnd.randrange(0, 14))]
        g = lexical.mine(sets)
        assert g.items == len(sets) and all(c > k for k, cs in enumerate(g.children) for c in cs)

        def whole(k):
            return g.own[k] + [t for c in g.children[k] for t in whole(c)]

        for k, s in enumerate(sets):
            assert sorted(whole(k)) == sorted(s)  # each term once
        used = Counter(c for cs in g.children for c in cs)
        assert all(used[k] > 1 for k in range(len(sets), len(g.own)))
        # No two sets share terms any more.
        assert all(len(set(g.own[a]) & set(g.own[b])) < lexical.SHARED for a in range(len(g.own)) for b in range(a))
    many = lexical.mine([set(range(40)) | {100 + i} for i in range(10)])
    assert many.additions == 39 + 10 and sum(len(s) for s in [set(range(40))] * 10) == 400


def test_terms_match_the_pattern():
    rnd = random.Random(6)
    for _ in range(300):
        t = "".join(chr(rnd.choice([rnd.randrange(0, 128), rnd.randrange(128, 0x3000), 0x1F600, 0xD800])) for _ in range(50))
        assert [x.decode("utf-8", "surrogatepass") for x in lexical.terms_of(t)] == terms(t)
