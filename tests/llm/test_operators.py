"""The operators against brute force, libraries and exact round trips, on awkward rows and on the small tables."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import html_text, language, packing, pieces, quality, simhash, substrings, tokens, topk
from hushgrid.llm import toxicity as toxic
from hushgrid.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF
from .conftest import PASSAGE, ROWS


def all_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Toxicity ---------------------------------------------------------------------------------------------------------


def test_segments_are_maximal():
    """Against the recursive definition: the best stretch, then the same to its left and right."""

    def best(s, lo, hi):
        found = max(((sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if found[0] <= 0:
            return []
        _, _, a, b = found
        return [*best(s, lo, a), (a, b), *best(s, b, hi)]

    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.uniform(-3, 2) for _ in range(rnd.randrange(0, 14))]
        assert [(a, b) for a, b, _ in toxic.segments(np.array(s))] == best(s, 0, len(s))


def test_extreme_values():
    """What some random scores say of chance holds for others."""
    rng = np.random.default_rng(2)
    draw = lambda n: np.where(rng.random(n) < 0.02, rng.exponential(1.0, n), 0) - 0.25
    n = 300_000
    islands = toxic.segments(draw(n))
    lam, k = toxic.extreme_value(n, len(islands), sum(x for _, _, x in islands))
    for over in (1.0, 2.0, 3.0):
        found = sum(x >= over for _ in range(4) for _, _, x in toxic.segments(draw(n)))
        assert found == pytest.approx(4 * k * n * np.exp(-lam * over), rel=0.25)
    assert toxic.extreme_value(0, 0, 0) == (1.0, 1.0)


def test_toxicity_is_the_method(spark):
    """Scores and passages by the definition: log-odds, segments and calibration anew in plain Python, from the same texts."""
    import math
    import re

    sf = SF.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    label = defaultdict(int)
    for r in labels.where("toxic IS NOT NULL").collect():
        if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5:
            label[text[r.doc_id]] = max(label[text[r.doc_id]], r.toxic)
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    of = [Counter(), Counter()]
    for t, y in label.items():
        of[y].update({f for w in set(words(t)) for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)]})
    n = [sum(v for f, v in c.items() if not f.endswith("*")) for c in of]
    weight, odds = toxic.PRIOR * min(n), {}
    for f in of[0].keys() | of[1].keys():
        prior = weight * (of[0][f] + of[1][f]) / sum(n)
        o = [math.log((of[k][f] + prior) / (n[k] + weight - of[k][f] - prior)) for k in (0, 1)]
        z = (o[1] - o[0]) / math.sqrt(1 / (of[1][f] + prior) + 1 / (of[0][f] + prior))
        if abs(z) >= toxic.DEVIATIONS:
            odds[f] = o[1] - o[0] - toxic.SURE * (o[1] - o[0]) / z
    model = toxic.fit(d, labels)
    assert model.odds.keys() == odds.keys()
    score = lambda w: min(max((odds[f] for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)] if f in odds), default=0.0), toxic.MOST) - toxic.DRIFT
    got = {r.doc_id: r for r in toxic.toxicity(d, labels).collect()}
    for i, t in text.items():
        w = words(t)
        over = math.log(model.k * len(w)) if w else 0
        found = [(a, b, model.lam * x - over) for a, b, x in toxic.segments(np.array([score(x) for x in w]))] if w else []
        found = [f for f in found if math.exp(-f[2]) < toxic.SIGNIFICANT]
        assert [(p.first, p.end) for p in got[i].passages] == [f[:2] for f in found]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log1p(sum(f[2] for f in found)) + model.shift))), rel=1e-6)
        assert got[i].predicted == (got[i].score >= 0.5)


def test_toxicity(spark, docs, empty):
    d, labels = all_docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxic.toxicity(d, labels).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in d.select("doc_id").collect()) and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    model = toxic.Model({"idiot": (5.0, 9.0), "scum": (5.0, 9.0)}, lam=1.0, k=0.01, slope=2.0, shift=-3.0)
    rows = spark.createDataFrame([(1, "you idiot, you scum"), (2, "hello there"), (3, None), (4, "")], "doc_id long, text string")
    s = {r.doc_id: r for r in toxic.score_documents(rows, model).collect()}
    assert s[1].score > 0.5 > s[2].score == s[3].score == s[4].score and [(p.first, p.end) for p in s[1].passages] == [(1, 4)]
    assert toxic.score_documents(docs, model).count() == len(ROWS) and toxic.toxicity(empty, labels).count() == 0
    none = toxic.toxicity(docs, labels.where("toxic = 0"))
    assert none.where("predicted = 1").count() == 0
    assert toxic.clean(docs, model).columns == docs.columns


# Language ---------------------------------------------------------------------------------------------------------


def test_language_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    word = lambda k, j: "".join(chr(0x4E00 + 40 * k + (7 * j + i * i) % 40) for i in range(4))
    rows = [(k * 100_000 + i, " ".join(word(k, i + j) for j in range(30)), f"l{k:02}") for k in range(70) for i in range(20)]
    rows += [(10**8 + i, "the cat sat on the mat and the dog sat by the door", "zz") for i in range(20_000)] + [(10**9 + i, "", "empty") for i in range(20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == [*(f"l{k:02}" for k in range(70)), "zz"]
    monkeypatch.setattr(language, "LANGUAGES", 5)  # shares are joined then
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).packed == model.packed
    assert all(next(iter(model.mixture(rows[k * 20][1]))) == f"l{k:02}" for k in range(70))


def test_language(spark, docs, empty):
    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    got = language.languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    model = language.fit(d)
    text = {r.lang: r.text for r in d.where("length(text) > 1500").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    mix = model.mixture(text["en"][:1400] + " " + text["de"][:600])
    assert list(mix)[:2] == ["en", "de"] and 0.15 < mix["de"] < 0.5 and sum(mix.values()) == pytest.approx(1)
    assert model.mixture(None) == model.mixture("") == model.mixture("123 ?!") == {}
    r = language.languages(docs).collect()
    assert len(r) == len(ROWS) and all(x.score == 0 for x in r if x.lang_pred == "und")
    assert {x.lang_pred for x in r if x.doc_id in (2, 3, 4)} == {"und"} and language.languages(empty).count() == 0


def test_language_is_the_method(spark):
    """Mixtures by the definition, in plain Python: trigrams, likelihoods, and expectation-maximisation over a set that
    grows by the language that gains most."""
    import math

    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in d.collect()]
    learned = {(i, t, g) for i, t, g in rows if g is not None and t and zlib.crc32(str(i).encode()) % 5}
    assert len(learned) < language.SAMPLE
    of = lambda t: Counter(language.trigrams(t).tolist())
    count = defaultdict(Counter)
    for _, t, g in learned:
        count[g].update(of(t))
    names = sorted(count)
    total = {g: sum(count[g].values()) + 0.1 * language.BUCKETS for g in names}
    model = language.fit(d)
    assert model.names == names
    mixed = [a[1][:300] + " " + b[1][:200] for a, b in zip(rows[:200:5], rows[3:200:5]) if a[1] and b[1]]
    for t in [t for _, t, _ in rows[:60] if t] + mixed:
        n = of(t)
        if not any(map(str.isalpha, t)):
            continue
        p = {x: {g: (count[g][x] + 0.1) / total[g] for g in names} for x in n}
        like = lambda share: sum(k * math.log(sum(w * p[x][g] for g, w in share.items())) for x, k in n.items())
        size = sum(n.values())
        share = {max(names, key=lambda g: like({g: 1.0})): 1.0}
        while len(share) < len(names):
            gain = {g: sum(k * p[x][g] / sum(w * p[x][h] for h, w in share.items()) for x, k in n.items()) for g in names if g not in share}
            new = max(gain, key=gain.get)
            if gain[new] <= size:
                break
            more = {g: 0.9 * w for g, w in share.items()} | {new: 0.1}
            for _ in range(language.STEPS):
                parts = {x: sum(w * p[x][g] for g, w in more.items()) for x in n}
                more = {g: w * sum(k * p[x][g] / parts[x] for x, k in n.items()) / size for g, w in more.items()}
            if like(more) - like(share) <= language.PENALTY * math.log(max(2, size)):
                break
            share = more
        got = model.mixture(t)
        assert got.keys() == share.keys() and all(got[g] == pytest.approx(w, abs=2e-3) for g, w in share.items())


# HTML -------------------------------------------------------------------------------------------------------------


def test_minimum_cut():
    """Against all labellings of small random graphs."""
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.randrange(1, 8)
        t = [(rnd.choice([0, 1, 2, 3.5]), rnd.choice([0, 1, 2, 3.5])) for _ in range(n)]
        e = {(a, b): rnd.choice([0.5, 1, 2.0]) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5}
        cost = lambda side: sum(k[1] if s else k[0] for s, k in zip(side, t)) + sum(w for (a, b), w in e.items() if side[a] != side[b])
        assert cost(html_text.minimum_cut(t, e)) == pytest.approx(min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n)))


def test_minimum_cut_of_a_long_page():
    import time

    rnd = random.Random(8)
    n = 30_000
    for pull in ([2.0 * (-1) ** k for k in range(n)], [3.0 * (k < n // 2) - 3.0 * (k >= n // 2) + rnd.uniform(-2.5, 2.5) for k in range(n)], [rnd.uniform(-3, 3) for _ in range(n)]):
        began = time.time()
        kept = html_text.minimum_cut([(max(0, x), max(0, -x)) for x in pull], {(k, k + 1): 3.0 for k in range(n - 1)} | {(k, k + 2): 1.0 for k in range(n - 2)})
        assert len(kept) == n and time.time() - began < 30


PAGE = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><header><h1>Site</h1><nav><ul><li><a href=x>Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First  para<br>with a <a href=q>link</a>, and more text.<p><b>Second&nbsp;para.</b>
<aside>Related stuff that is long enough to look like it.</aside><form><label>Name</label></form><ul><li>One<li>Two</ul><!-- no --></article>
<section id="comments"><p>I am a reader, and this is a long comment, indeed. I say so.</p></section><footer>&copy; bye</footer>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst para with a link, and more text.\n\nSecond para.\n\nOne\n\nTwo"
    for text in (None, "", "<", "<p", "<div><span></div>", "<script>x", "<!-- x"):
        assert html_text.main_text(text) == ""
    deep = "<div>" * 3000 + "<p>A paragraph that is long enough, surely.</p>" + "</div>" * 3000
    assert html_text.main_text(deep) == "A paragraph that is long enough, surely."
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (1, "u", PAGE, 0), (None, None, None, 0)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got) and html_text.extract(pages.where("1 = 0")).count() == 0


def test_html_unclosed_and_empty_elements():
    long = "A paragraph that is long enough to be content, surely it is."
    for icon in ('<svg class="i" />', "<math/>", "<svg><path d=x></path></svg>"):
        assert html_text.main_text(f"<body><article><p>Begin {icon} of it.</p><p>{long}</p></article></body>") == f"Begin of it.\n\n{long}"
    for tag in ("object", "canvas", "audio", "video", "select", "template", "noscript"):
        assert html_text.main_text(f"<body><article><div><{tag}>gone</div><p>{long}</p></article></body>") == long
    assert html_text.main_text(f"<head><title>T</title><meta name=x><article><p>{long}</p></article>") == long


def test_html_names_and_forms_do_not_outbid_an_article():
    """A form around the page, and paragraphs in an article by any name, stay; widgets in it by such names go."""
    long = "This paragraph tells at some length, and in whole sentences, what happened. It goes on, as articles do."
    whole = f"{long}\n\n{long}"
    for around in ("<form id=aspnetForm>", "<form><div class=wrap>", "<div class='sidebar-right'><form action=x>"):
        assert html_text.main_text(f"<body>{around}<input type=hidden><article><p>{long}</p><p>{long}</p></article></form></body>") == whole
        assert html_text.main_text(f"<body>{around}<main><p>{long}</p><p>{long}</p></main></form></body>") == whole
    assert html_text.main_text(f"<body><form id=aspnetForm><div>{f'<p>{long}</p>' * 8}</div></form></body>") == "\n\n".join([long] * 8)
    for name in "more tags legal search foot side alert notice ads social follow menu related-work discussion promo skip".split():
        assert html_text.main_text(f"<article><p>{long}</p><p class='{name}'>{long}</p></article>") == whole, name
        assert html_text.main_text(f"<article><p>{long}</p><section class='{name}'><p>{long}</p></section></article>") == whole, name
        assert html_text.main_text(f"<article><p class='{name}'>Short.</p><p>{long}</p></article>") == f"Short.\n\n{long}", name
    for widget in ("<div class=share><a href=x>Share</a> <a href=y>Tweet</a></div>", "<form><label>Mail</label><input><button>Go</button></form>", "<aside>Another thing.</aside>", "<ul class=tags><li><a href=t>tag</a></ul>", f"<div id=comments><p>{long}</p></div>", "<div class='ad'><a href=b>Buy now</a></div>"):
        assert html_text.main_text(f"<article><p>{long}</p>{widget}<p>{long}</p></article>") == whole, widget


def test_html_articles(spark):
    """On the given pages: all text of the article, and nothing else."""
    import html
    import re

    for r in QUERIES["op3_html"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts]
        assert r.text == "\n\n".join(filter(None, want))


def test_html_without_landmarks(spark):
    """Pages robbed of their article, their names and their headings: the cut mends labels that looks alone get wrong."""
    import re

    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    model = html_text.fit(pages)
    sign, cut, changed, n = 0, 0, 0, 0
    for r in pages.collect():
        true = [b.content >= html_text.CONTENT and not b.boiler for b in html_text.blocks(r.html)]
        bare = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer|h1)\b[^>]*>", r"<\1div>", r.html))
        bare = re.sub(r"<div>([^<]*)</div>", r"<p>\1</p>", bare)
        page = html_text.blocks(bare)
        assert len(page) == len(true)
        prices = html_text.prices(page, model)
        kept, looked = html_text.minimum_cut(prices, html_text.ties(page)), [a > b for a, b in prices]
        n += len(page)
        sign += sum(x != y for x, y in zip(looked, true))
        cut += sum(x != y for x, y in zip(kept, true))
        changed += kept != looked
    assert changed > 0 and cut < sign and cut < 0.01 * n, (cut, sign, changed, n)


def test_html_is_linear():
    import time

    pages = {
        '<a "': ("<p>x</p><a " + '"' * 200_000, "x"), "<a": ("<a " * 200_000, ""), "<a x=": ('<a x="' * 100_000, ""), "<": ("<" * 300_000, None), "<script>": ("<script>" * 100_000, ""), "<!--": ("<!--" * 200_000, ""),
        "<b>": ("<b>" * 50_000 + "<p>x" * 50_000, None), "hidden": ("<div hidden>" + "<div>" * 100_000 + "x", ""), "deep": ("<div>" * 100_000 + "<p>A paragraph.</p>" + "</div>" * 100_000, None), "</p>": ("</p>" * 200_000, ""),
        "attributes": ("<p " + "a = " * 200_000 + ">x", None), "blanks": ("<p a" + " " * 500_000 + "b>x", None), "=": ("<p " + "=" * 500_000 + ">x", None), "flow": ("<p>a, b.</p><li>x</li>" * 30_000, None),
    }
    for name, (page, text) in pages.items():
        began = time.time()
        got = html_text.main_text("<article><p>A first paragraph, to begin with.</p></article>" + page)
        assert time.time() - began < 20, name
        assert got.startswith("A first paragraph") and (text is None or text == "" or name == '<a "'), name


def test_html_scripts_and_broken_tags():
    first = "First of all, here is a paragraph."
    for page in (
        f"""<script>document.write('<a href="');</script><article><p>{first}</p></article>""", f"<script>x = '</p><p>';</SCRIPT ><article><p>{first}</p></article>", f"<style>a > b</style><article><p>{first}</p></article>",
        f"<!--><article><p>{first}</p></article><!-- > -->", f"<article><p title='a > b' data-x=\"</p>\">{first}</p></article>", f'<article><p title=">{first}</p></article>', f"<article><p>{first}</p></article><a href='x",
        f"<textarea><p>no</p></textarea><article><p>{first}</article>", f"<article><p>{first}</p></article><p", f"<article><? x ?><p>{first}</p><![CDATA[ <p>no</p> ]]></article>",
    ):
        assert html_text.main_text(page) == first, page
    own = f"<article><h1>Head</h1><p>{first}</p></article>"
    assert html_text.main_text(f"{own}<section id='comments'><article class='comment'><p>I am a reader, and I say so at some length.</p></article></section>") == f"Head\n\n{first}"
    assert html_text.main_text(f"<div class='sidebar-layout'>{own}</div><aside><article><p>Another article to read, in short.</p></article></aside>") == f"Head\n\n{first}"
    assert html_text.main_text("<article><p>1 < 2 and 3 > 2, a <b>bold</b> claim.</p></article>") == "1 < 2 and 3 > 2, a bold claim."


# SentencePiece ----------------------------------------------------------------------------------------------------


def test_pieces(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = pieces.encoder()
    rnd = random.Random(7)
    letters = [*"abcdefghij etao  in.,'(){}_²1", "the", "ing", "    ", "\n", "\t", "é", "漢", "😀", "▁", "́", "aaaa", "=="]
    for _ in range(3000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 30)))
        assert own.encode(s)[0] == library.encode(s), repr(s)
    for s in ("a" * 3000, " " * 2000, "ab" * 2000, "=" * 777, ""):
        assert own.encode(s)[0] == library.encode(s)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest_pieces(docs).collect())
    want = Counter()
    for i, t, _ in ROWS:
        ids = library.encode(t) if t else []
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest()] += 1
    assert got == want and pieces.digest_pieces(empty).count() == 0
    d = all_docs(spark).select("doc_id", "text")
    back = pieces.decode_pieces(pieces.encode_pieces(d)).withColumnRenamed("text", "back").join(d, "doc_id")
    assert back.where("text <> back").count() == 0 and back.count() == d.count()


# SimHash ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    above = {i: i for i in range(len(prints))}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                above[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("source", ["awkward", "table"])
def test_simhash(spark, docs, source):
    d = docs if source == "awkward" else all_docs(spark)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    group = slow_components(prints)
    least = defaultdict(lambda: None)
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = i if least[g] is None else min(i, least[g])
    want = Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group))
    assert Counter(tuple(r) for r in simhash.near_duplicates(d).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_simhash_links(spark, monkeypatch):
    """All links of random neighbourhoods are found, also where runs are long and are filed anew."""
    rnd = random.Random(5)
    prints = set()
    for _ in range(40):
        f = rnd.getrandbits(64)
        prints |= {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 6))) for _ in range(rnd.randrange(1, 40))}
    prints = sorted(prints)
    group = slow_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for a, b in [(k.a, k.b) for k in simhash.links(df).collect()]:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    key = np.zeros(len(prints), np.int64)
    monkeypatch.setattr(simhash, "LONG", 4)
    # One run over LONG that passes through in several batches, between two short ones.
    keys, rows = np.array([1, 1, *[2] * 12, 3, 3]), np.arange(16, dtype=np.int64)
    parts = [simhash.pa.record_batch({"key": keys[k : k + 5], "fp": rows[k : k + 5]}) for k in range(0, 16, 5)]
    held = [r for b in simhash._merge_runs(iter(parts), True) for r in b.to_pylist()]
    assert sorted(r["a"] for r in held if r["b"] is None) == list(range(2, 14)) and {(r["a"], r["b"]) for r in held if r["b"] is not None} == {(0, 1), (14, 15)}
    joined = slow_groups(signed, [(k.a, k.b) for k in simhash.links(df).collect()])
    assert joined == slow_groups(signed, ((signed[i], signed[g]) for i, g in enumerate(group)))
    for limit in (32, 1):
        monkeypatch.setattr(simhash, "SHORT", limit)
        a, b = simhash._pairs_of_runs(key, np.array(prints, np.uint64))
        joined = slow_groups(prints, zip(np.concatenate(a).tolist(), np.concatenate(b).tolist()))
        assert joined == slow_groups(prints, ((prints[i], prints[g]) for i, g in enumerate(group))) or limit == 32


def slow_groups(nodes, edges):
    above = {n: n for n in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        above[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_one_of_each(spark, docs, empty):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(set(ids)) and 1 in ids and 5 not in ids and 11 in ids and 12 not in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_of_each_tells_texts_apart(spark):
    text = lambda k: " ".join(f"w{k}_{i}" for i in range(60))
    rows = [(None, text(k)) for k in range(5)] + [(None, text(0)), (1, text(5)), (1, text(6)), (2, text(6)), (None, text(6)), (None, None), (None, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text or "" for r in kept) == sorted(["", *(text(k) for k in range(7))])
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 1]


# Top-k ------------------------------------------------------------------------------------------------------------


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    vectors += [(i + 300, v) for i, v in vectors[:20]] + [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, vectors[0][1]), (1100, [0.5, 0.5]), (1200, [])]
    vectors += [vectors[7]] * 3 + [(500, vectors[9][1])] * 2
    df = spark.createDataFrame([(*v, 0, 0) for v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    for name, value in (("BLOCK", 64), ("LEAST", 16), ("QUERIES", 2), ("SAMPLE", 30), ("RESCORED", 0.01)):
        monkeypatch.setattr(topk, name, value)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    whole = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vectors if i is not None and i not in (1000, 1001, 1002, 1003)]
    want = {}
    for q in {i for i, _ in whole if i % 100 == 0}:
        best = sorted((-int(x @ v), i) for j, x in whole if j == q for i, v in whole if i != q and len(v) == len(x))[:10]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.top_k(df.where("1 = 0"), df).count() == 0 and topk.top_k(df, df.where("1 = 0")).count() == 0


def test_topk_scores_fit(spark):
    """What has no long is an error, not another number."""
    ok = spark.createDataFrame([(1, [3e5, 1.0]), (2, [3e5, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.score) for r in topk.top_k(ok, ok).collect()} == {(1, 307_200_000**2 + 2 * 1024**2), (2, 307_200_000**2 + 2 * 1024**2)}
    far = spark.createDataFrame([(1, [3e37, 1.0]), (2, [3e37, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too long for scores"):
        topk.top_k(far, far).collect()


def test_topk_reads_less(spark):
    """The given vectors look alike in all directions, the worst case; a vector near its neighbours reads far less."""
    v = np.floor(1024 * np.array([r.embedding for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").where("size(embedding) = 64").orderBy("vec_id").collect()])).astype(np.int64)
    ids = np.arange(len(v))
    index = topk.ImpactIndex(ids, np.ones(len(v), np.int64), v)
    shares = []
    for q in range(0, len(v), 40):
        exact = np.where(ids == q, -(1 << 60), v @ v[q])
        places, scores, read = index.search(v[q], 10, q, np.sort(exact)[-20])
        assert places.tolist() == np.lexsort((ids, -exact))[:10].tolist() and scores.tolist() == exact[places].tolist()
        shares.append(read / v.size)
    assert np.mean(shares) < 0.55
    huge = np.array([[3 << 28, 1], [3 << 28, 2], [-(3 << 28), 5], [1 << 29, 1 << 29]])
    places, scores, _ = topk.ImpactIndex(np.arange(4), np.ones(4, np.int64), huge).search(huge[0], 2, 0)
    assert places.tolist() == [1, 3] and scores.tolist() == [int(huge[0] @ huge[1]), int(huge[0] @ huge[3])]


# Packing ----------------------------------------------------------------------------------------------------------


def check_pieces(rows, texts, size):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist() and sum(r.length for r in s) <= size
    for doc, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.doc_tokens == len(ids) and r.length > 0 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    short = [s for s in by_seq.values() if sum(r.length for r in s) < size]
    assert len(short) <= 1


def test_packing(spark, docs, empty, monkeypatch):
    d = all_docs(spark)
    check_pieces(packing.pack(d.repartition(7)).collect(), dict(d.select("doc_id", "text").collect()), 1024)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    once = {i: t for i, t, _ in ROWS if i not in (None, 9)}
    check_pieces(packing.pack(docs.where("doc_id <> 9").repartition(5), size=64, open_windows=3).collect(), once, 64)
    n = packing.pack(docs).agg(F.sum("length")).first()[0]
    assert n == sum(packing.byte_bpe()(t).size + 1 if t else 1 for _, t, _ in ROWS)
    assert packing.pack(empty).count() == 0


# Token counts -----------------------------------------------------------------------------------------------------


def test_allocation():
    spans, sections = np.array([2, 5, 6, 12]), np.array([3, 3, 4, 6, 12])
    n, crossing = tokens.allocate(spans, sections)
    # 0-2 to the first; 2-5 lies in three with a byte each: the first; 5-6 to the fourth; 6-12 to the last.
    assert n.tolist() == [2, 0, 0, 1, 1] and crossing.tolist() == [1, 0, 0, 0, 0]


LONG_RUNS = {k: c * 2_000_000 for k, c in enumerate((" ", "\n", "a", "\t \n"), 100)} | {104: "x" + " " * 1_000_000 + "y <|endoftext|>", 105: "<|endoftext|>"}


def library_tokens():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_byte_bpe_is_the_library():
    own, library = tokens.byte_bpe(), library_tokens()
    rnd = random.Random(11)
    letters = [*"abcdefghij etao  in.,'(){}_²1", "the", "ing", "    ", "\n", "\t", "é", "漢", "😀", "\u0301", "'s", "<|endoftext|>", "|>", "\x00", "\xa0", "\u2003"]
    for s in ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 30))) for _ in range(3000)] + list(LONG_RUNS.values()):
        ids = own(s)
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids, repr(s[:60])
        assert own.size[ids].sum() == len(s.encode())


def slow_sections(text, library):
    """(start, end, tokens, crossing) of each line: every byte of the text belongs to a token and to a line."""
    ids = library.encode(text, add_special_tokens=False).ids
    size = {i: 13 if i == 50256 else len(library.id_to_token(i)) for i in set(ids)}  # a character of a token is a byte
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + lines[-1:]
    of = [k for k, x in enumerate(lines) for _ in x.encode()]
    out, at = [[0, 0] for _ in lines], 0
    for i in ids:
        held = Counter(of[at : at + size[i]])
        owner = min(held, key=lambda k: (-held[k], k))
        out[owner][0] += 1
        out[owner][1] += len(held) > 1
        at += size[i]
    ends = np.cumsum([len(x) for x in lines]).tolist()
    return [(k, a, b, *n) for k, (a, b, n) in enumerate(zip([0, *ends], ends, out))]


def test_token_counts(spark, docs, empty):
    library = library_tokens()
    for d in (docs, all_docs(spark), docs.limit(1).select(F.lit(7).alias("doc_id"), F.lit("a\n\n \n\n\nb <|endoftext|>\n漢\n" * 3).alias("text"))):
        want = Counter((r.doc_id, "text", *x) for r in d.select("doc_id", "text").collect() for x in slow_sections(r.text or "", library))
        assert Counter(map(tuple, tokens.section_tokens(d).collect())) == want
    both = tokens.section_tokens(docs, fields=("lang", "text")).where("doc_id = 1").toPandas()
    assert both.field.tolist() == ["lang", "text"] and both.n_tokens.sum() == len(library.encode("en\n" + ROWS[0][1], add_special_tokens=False).ids)
    assert tokens.section_tokens(empty).count() == 0


def test_long_runs(spark):
    """Texts that a backtracking pattern can't take are packed and counted like others."""
    library = library_tokens()
    d = spark.createDataFrame(list(LONG_RUNS.items()), "doc_id long, text string")
    check_pieces(packing.pack(d).collect(), LONG_RUNS, 1024)
    got = dict(tokens.section_tokens(d.where("doc_id <> 103")).groupBy("doc_id").agg(F.sum("n_tokens")).collect())
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in LONG_RUNS.items() if i != 103}


# Quality ----------------------------------------------------------------------------------------------------------


def slow_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(covered)


def test_quality_counts(spark, docs, empty):
    for _, t, _ in ROWS:
        assert quality.counts(t) == slow_counts(t)
    for r in all_docs(spark).select("text").collect():
        assert quality.counts(r.text) == slow_counts(r.text)
    rnd = random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "b", " ", " ", "\n", "#", "\x0b"]) for _ in range(rnd.randrange(0, 40)))
        assert quality.counts(t) == slow_counts(t)
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS) and not any(r.kept for r in got if r.base_failed) and all(r.base_failed for r in got if r.n_words < 50)
    assert quality.judge(empty).count() == 0 and quality.good(empty).count() == 0 and quality.good(docs).columns == docs.columns


def test_quality_keeps_clean(spark):
    sf = SF.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    j = quality.judge(d).join(labels, "doc_id").where("NOT base_failed")
    assert j.where("quality = 1 AND kept").count() / j.where("quality = 1").count() > 0.97


def slow_costs(texts):
    """-log p of a character after those before it, by the definition: interpolated modified Kneser-Ney, from which
    n-grams of one text alone are left out."""
    span = quality.SPAN
    count, holders = [Counter() for _ in range(span + 1)], defaultdict(set)
    for t in texts:
        s = " " * (span - 1) + t
        for i in range(len(s) - span + 1):
            count[span][s[i : i + span]] += 1
            for k in range(1, span + 1):
                holders[s[i + span - k : i + span]].add(t)
    for k in range(span - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    discount = [None]
    for k in range(1, span + 1):
        n1, n2, n3, n4 = (max(1, sum(v == j for v in count[k].values())) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discount.append([0, *(min(max(0.1, j - (j + 1) * y * b / a), j) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])
    after = [defaultdict(list) for _ in range(span + 1)]
    for k in range(1, span + 1):
        for g, v in count[k].items():
            after[k][g[:-1]].append(v)

    def free(context):
        same = after[len(context) + 1].get(context)
        return sum(discount[len(context) + 1][min(v, 3)] for v in same) / sum(same) if same else 1.0

    def p(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        same, v = sum(after[len(g)][g[:-1]]), count[len(g)][g]
        return (v - discount[len(g)][min(v, 3)]) / same + free(g[:-1]) * p(g[1:])

    def cost(g):
        if not g or len(holders[g]) > 1:
            return -np.log(p(g))
        return cost(g[1:]) - (np.log(free(g[:-1])) if not g[:-1] or len(holders[g[:-1]]) > 1 else 0)

    return cost


QUALITY_TEXTS = ["the cat sat on the mat", "the cat sat on the mat", "the dog sat by the door\tand slept", "a zebra QUIT 99 mats; the cat", "# # # % & * $ odd", "the \U0001f600 and 漢字"]


def slow_means():
    """(language, text) -> log perplexity, for QUALITY_TEXTS in English and two Russian texts without a language."""
    span, out = quality.SPAN, {}
    for lang, texts in (("en", QUALITY_TEXTS), (None, ["Кот сидит. Кот спит", "кот спит 12 漢字"])):
        plain = [t.replace("\t", " ") for t in texts]
        cost = slow_costs([t for t in plain if sum(map(t.count, quality.SIGNS)) <= 0.1 * len(t.split())])
        for t, own in zip(texts, plain):
            s = " " * (span - 1) + own
            out[lang, t] = np.mean([cost(s[i : i + span]) for i in range(len(t))])
    return out


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_perplexity_is_kneser_ney(spark, monkeypatch, most):
    """By the definition, whether workers get the whole model or parts join it, also where texts are cut into pieces."""
    monkeypatch.setattr(quality, "BROADCAST", most)
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    monkeypatch.setattr(quality, "PART", 50)
    want = slow_means()
    rows = [(i, t, g) for i, (g, t) in enumerate([*want, ("en", QUALITY_TEXTS[0])])]
    got = quality.judge(spark.createDataFrame([*rows, (98, None, "en"), (99, "", None)], "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r.perplexity is None if r.doc_id > 90 else np.log(r.perplexity) == pytest.approx(want[rows[r.doc_id][2], rows[r.doc_id][1]], rel=1e-4)


def test_quality_hash_array():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        array, wanted = quality.HashArray(keys), np.concatenate((keys, keys + np.uint64(1), np.array([0, 3, (1 << 64) - 2], np.uint64)))
        at, known = array.find(wanted)
        assert known.tolist() == np.isin(wanted, keys).tolist() and (array.keys[at[known]] == wanted[known]).all()


def test_quality_vocabulary(monkeypatch):
    monkeypatch.setattr(quality, "WAITING", 40)
    texts = ["abab abab abab", "abab", "漢字漢字漢字", "abab abab abab"]
    found = quality.Vocabulary()
    for _ in range(3):
        for k, s in quality._stretches([quality.points(t) for t in texts], ["x", "x", "y", "y"]):
            found.add(s, [["x", "x", "y", "y"][i] for i in k], np.array([1, 2, 3, 1], np.int32)[k])
    want, tags = Counter(), defaultdict(set)
    for t, g, tag in zip(texts, "xxyy", (1, 2, 3, 1)):
        for i in range(len(t)):
            gram = (" " * (quality.SPAN - 1) + t)[i : i + quality.SPAN]
            want[g, gram] += 3
            tags[g, gram].add(tag)
    rows = found.rows().to_pylist()
    assert {(r["lang"], r["gram"]): r["n"] for r in rows} == want and len(rows) == len(want)
    assert all(r["tag"] == (min(x) if len(x := tags[r["lang"], r["gram"]]) == 1 else 0) for r in rows)


def test_quality_bands(spark):
    """Quartiles and verdicts by the definition, on the given table."""
    got = quality.judge(all_docs(spark)).join(all_docs(spark).select("doc_id", "lang"), "doc_id").where("NOT base_failed").toPandas()
    for _, own in got.groupby("lang"):
        x = np.sort(np.round(np.log(own.perplexity) * quality.GRAIN) / quality.GRAIN)
        low, mid, high = (x[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.5, 0.75))
        wide = quality.REACH * 0.7413 * (high - low)
        lower, upper = np.exp(mid - max(quality.LEAST_DOWN, wide)), np.exp(mid + max(quality.LEAST_UP, wide))
        assert own.lower.to_numpy() == pytest.approx(lower) and own.upper.to_numpy() == pytest.approx(upper)
        assert (own.kept == own.perplexity.between(own.lower, own.upper)).all()


def test_quality_rejects_poor(spark):
    sf = SF.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    j = quality.judge(d).join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id").where("NOT base_failed")
    assert j.where("quality = 0").count() > 20
    for r in j.groupBy("lang").agg(F.expr("avg(int(kept)) FILTER (WHERE quality = 0)").alias("poor"), F.expr("avg(int(kept)) FILTER (WHERE quality = 1)").alias("sound")).collect():
        assert (r.poor or 0) < 0.5 and r.sound > 0.97


def test_quality_sees_letters_of_any_script(spark):
    rnd = random.Random(5)
    letters = "абвгдежзиклмнопрстуфхцчшыьэюя"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(150)]
    prose = [" ".join(rnd.choice(words) for _ in range(200)) for _ in range(40)]
    noise = ["".join(rnd.choice(letters) if c != " " else c for c in t) for t in prose[:4]]
    rows = [(i, t, "ru") for i, t in enumerate(prose + noise)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert min(got[40 + i].perplexity for i in range(4)) > 1.5 * max(got[i].perplexity for i in range(40))
    assert all(got[i].kept == (i < 40) for i in got)


# Substrings -------------------------------------------------------------------------------------------------------


def slow_repeats(rows, window=20):
    """Removed places of each (id, text), in order of (id, text's hash, start); null ids last."""
    seen, out = {}, {}
    for key, words in rows:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if seen.setdefault(w, (key, k)) != (key, k):
                gone[k : k + window] = [True] * window
        out[key] = gone
    return out


@pytest.mark.parametrize("source", ["awkward", "table", "random"])
def test_substrings(spark, docs, source):
    if source == "random":
        rnd = random.Random(9)
        base = [[f"w{rnd.randrange(4)}" for _ in range(60)] for _ in range(6)]
        texts = [" ".join(rnd.choice(base)[rnd.randrange(30) :] + [f"w{rnd.randrange(4)}" for _ in range(rnd.randrange(30))] + rnd.choice(base)[: rnd.randrange(60)]) for _ in range(120)]
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    else:
        d = docs if source == "awkward" else all_docs(spark)
    rows = d.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th")).collect()
    keyed = {((r.doc_id if r.doc_id is not None else (1 << 63) - 1), r.th): (r.text or "").encode().split() for r in rows}
    gone = slow_repeats(sorted(keyed.items()))
    want = Counter()
    for r in rows:
        key = (r.doc_id if r.doc_id is not None else (1 << 63) - 1), r.th
        kept = [w for w, g in zip(keyed[key], gone[key]) if not g]
        want[r.doc_id, len(keyed[key]), len(keyed[key]) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.repeat_digest(d).collect()) == want
    assert sum(sum(g) for g in gone.values()) > 0


def test_remove_repeats(spark, docs, empty):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert got[7].text == f"Before it. {PASSAGE} after it" and got[8].text == "Something else goes on" and got[2].text is None and got[3].text == "" and got[14].text == ROWS[17][1]
    assert substrings.remove_repeats(docs).columns == docs.columns and substrings.remove_repeats(empty).count() == 0 and substrings.repeat_digest(empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
