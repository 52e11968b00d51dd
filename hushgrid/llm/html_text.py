"""Main text of a web page by minimum cut.

A page is cut into blocks of text. A linear classifier, fitted on pages that say themselves where their article is, prices
each block as content and as boilerplate by its looks (length, links, punctuation, kind of element, neighbours); elements
and names with a meaning add to the prices. The prices are the capacities of edges from and to two terminals. Blocks that
follow each other, and blocks that are near in the tree, are tied by smoothness edges. A maximum flow gives the cheapest
labelling, which keeps runs of like blocks together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import map_rows

#: Elements whose content is no text.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select datalist".split())
#: Those of them whose content is plain characters up to their own end tag, and what a head may hold.
RAW = frozenset("script style textarea title".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph when they begin.
_ends_p = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
#: Elements that hold boilerplate, and names that do when they are part of a class, an id or a role.
BOILER_TAGS = frozenset("nav footer aside menu dialog button".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu menubar footer foot header masthead topbar sidebar side rail aside ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search comment comments reply replies disqus discussion respond reviews "
    "share sharing social follow related recommended recommendations recommend more breadcrumb breadcrumbs crumbs pagination pager widget toolbar skip copyright legal tags toc complementary contentinfo".split()
)
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset("article articlebody content entry post story text body main maincontent postbody".split())
#: Names of what readers wrote and of other pages' teasers: no article inside makes them content. Within an article only the
#: first do without the classifier's agreement, as a section may be called discussion or related work.
READERS_NAMES = frozenset("comment comments reply replies disqus respond".split())
OTHERS_NAMES = READERS_NAMES | frozenset("discussion reviews related recommended recommendations recommend".split())
#: Elements of running text: within an article their names say nothing.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption li dt dd td th".split())
#: Prices: in a boilerplate element or name, in such a name within an article, in a content element or name, and the most that
#: a block's looks count. A name within an article is outbid by the article, unless the looks agree with it.
BOILER, NAMED, NAMED_INSIDE, CONTENT, CONTENT_NAMED, LOOKS = 12.0, 9.0, 5.0, 6.0, 3.0, 4.0
#: Code points outside links from which a form is one around the page, not one to fill in.
FORM_TEXT = 600
#: Smoothness edges: between blocks that follow each other, more if they share a parent, and between the nearest blocks of
#: one parent. A landmark between two blocks cuts their edge.
NEXT, SAME, SIBLING = 2.0, 1.0, 1.0
#: Pages that the classifier is fitted on, about, picked by hash; weight of the ridge in its covariance.
SAMPLE, RIDGE = 2000, 0.1
#: Capacities below which an edge is full.
TINY = 1e-9

_name = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name, up to its end. A quote opens a string only behind an equals sign, and if it is closed.
_rest = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+>")
_attr = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_part = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    linked: int
    boiler: float
    content: float
    landmark: int
    parent: int
    form: int = 0


@dataclass(slots=True, eq=False)
class _Open:
    """An open element. hidden: its text isn't shown; dead: it lies in an element of HIDDEN; form: the number of the form around
    it; block: the nearest element around its text that is no inline one, and holder: the number of the next such element above."""

    tag: str
    boiler: float
    content: float
    landmark: int
    number: int
    hidden: bool
    dead: bool = False
    form: int = 0
    block: _Open | None = None
    holder: int = 0


def _marks(tag: str, attrs: str, inside: bool = False) -> tuple[float, float, bool]:
    """What an element says about its text: boilerplate, content, hidden. inside: it lies in an article."""
    boiler, content = BOILER if tag in BOILER_TAGS else 0.0, CONTENT if tag in CONTENT_TAGS else 0.0
    hidden = False
    if attrs and attrs.strip(" /"):
        for name, value in _attr.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role", "itemprop"):
                names = {w.lower() for w in _part.findall(value)} | {value.lower()}
                if tag not in ("html", "body", "main") and not (inside and tag in PROSE):
                    if names & (READERS_NAMES if inside else OTHERS_NAMES):
                        boiler = BOILER
                    elif tag == "article":
                        pass
                    elif names & BOILER_NAMES:
                        boiler = max(boiler, NAMED_INSIDE if inside else NAMED)
                    elif names & CONTENT_NAMES:
                        content = max(content, CONTENT_NAMED)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value.lower()):
                hidden = True
    return boiler, content, hidden


def _markup(html: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text in front, tag in small letters, its attributes, whether it is an end tag), and last the text that is left
    with an empty tag. One pass: comments, declarations and the content of raw-text elements are skipped, and a tag that
    the page's end cuts off ends it."""
    at = begin = 0
    last = html.rfind(">")
    n = len(html)
    while True:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c = html[lt + 1]
        if c in "!?" or c == "/" and not html[lt + 2 : lt + 3].isalpha():
            if html.startswith("<!--", lt):
                end, mark = html.find("-->", lt + 2), 3
            elif html.startswith("<![CDATA[", lt):
                end, mark = html.find("]]>", lt), 3
            else:
                end, mark = html.find(">", lt), 1
            yield html[begin:lt], "", "", False
            begin = at = end + mark if end >= 0 else n
            continue
        close = c == "/"
        name = _name.match(html, lt + 1 + close)
        if not name:
            at = lt + 1
            continue
        rest = _rest.match(html, name.end()) if name.end() <= last else None
        if not rest:  # cut off
            yield html[begin:lt], "", "", False
            return
        tag = name[0].lower()
        yield html[begin:lt], tag, rest[0][:-1], close
        begin = at = rest.end()
        if tag in RAW and not close:
            end = _raw_end[tag].search(html, at)
            begin = at = end.end() if end else n
    yield html[begin:], "", "", False


def blocks(html: str) -> list[Block]:
    """Blocks of visible text in page order, in linear time. Broken markup is read as far as it goes; text outside tags
    counts."""
    out: list[Block] = []
    root = _Open("", 0.0, 0.0, 0, 0, False)
    root.block = root
    stack = [root]
    open_tags: dict[str, int] = {}
    number, texts, linked = 0, [], 0

    def flush() -> None:
        nonlocal texts, linked
        if texts:
            text = " ".join(unescape("".join(texts)).split())
            if text:
                top = stack[-1].block
                out.append(Block(text, top.tag, linked, top.boiler, top.content, top.landmark, top.holder, top.form))
            texts, linked = [], 0

    def push(tag: str, boiler: float, content: float, landmark: int, hidden: bool, dead: bool, form: int) -> None:
        top = stack[-1]
        new = _Open(tag, boiler, content, landmark, number, hidden, dead, form)
        new.block, new.holder = (top.block, top.holder) if hidden or tag in INLINE else (new, top.block.number)
        stack.append(new)
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def pop(tag: str) -> None:
        while len(stack) > 1:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            if gone.tag == tag:
                break

    def add(raw: str) -> None:
        nonlocal linked
        if stack[-1].tag == "head" and raw.strip():
            pop("head")
        if raw and not stack[-1].hidden:
            texts.append(raw)
            if open_tags.get("a"):
                linked += len(raw)

    for text, tag, attrs, close in _markup(html):
        add(text)
        if not tag:
            continue
        if close:
            closed = next(x for x in reversed(stack) if x.tag == tag) if open_tags.get(tag) else None
            if tag not in INLINE and tag not in HIDDEN and not (closed or stack[-1]).hidden:
                flush()
            if closed:
                pop(tag)
            continue
        if open_tags.get("head") and (tag == "body" or stack[-1].tag == "head" and tag not in HEAD):
            pop("head")  # its end tag may be left out
        if tag == "br":
            add("\n")
            continue
        if tag in RAW:
            continue
        top = stack[-1]
        if tag in HIDDEN and tag != "head":
            if not (tag in ("svg", "math") and attrs.endswith("/")):
                number += 1
                push(tag, top.boiler, top.content, top.landmark, True, True, top.form)
            continue
        if tag not in INLINE and not top.dead:
            flush()
            if tag in _ends_p and open_tags.get("p"):
                pop("p")
            elif tag in ("tr", "td", "th", "option") and open_tags.get(tag) and stack[-1].tag == tag:
                pop(tag)
            if tag == "li" and stack[-1].tag == "li":
                pop("li")
        if tag in VOID:
            continue
        top = stack[-1]
        boiler, content, hidden = _marks(tag, attrs, top.content >= CONTENT)
        number += 1
        if tag == "header" and not top.content:
            boiler = BOILER
        # An article or main part outbids the names around it, but nothing makes an article of others' words, a menu or a
        # margin; a sign of boilerplate inside content holds.
        around = 0.0 if tag == "main" or tag == "article" and top.boiler <= NAMED else top.boiler
        landmark = number if boiler or content or tag in ("section", "form") else top.landmark
        form = 0 if tag in CONTENT_TAGS else top.form or (number if tag == "form" else 0)
        push(tag, max(around, boiler), max(top.content, content), landmark, top.hidden and not (tag == "body" and not top.dead) or hidden or tag == "head", top.dead, form)
    flush()
    told: dict[int, int] = {}
    for b in out:
        told[b.form] = told.get(b.form, 0) + max(0, len(b.text) - b.linked)
    for b in out:  # a form to fill in is boilerplate, one around a page isn't
        if b.form and told[b.form] < FORM_TEXT:
            b.boiler = max(b.boiler, BOILER)
    return out


FEATURES = 15


def looks(page: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: no names, and no elements with a meaning for the whole page."""
    n = len(page)
    size = np.array([len(b.text) for b in page], float)
    link = np.minimum(1, np.array([b.linked for b in page], float) / size)
    words = np.array([b.text.count(" ") + 1 for b in page], float)
    out = np.zeros((n, FEATURES))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), link, size / words / 10
    for k, b in enumerate(page):
        out[k, 3] = b.text[-1] in ".!?:;…”\"'»"
        out[k, 4] = min(1.0, 20 * (b.text.count(". ") + b.text.count(", ")) / size[k])
        out[k, 5], out[k, 6], out[k, 7] = b.tag in ("p", "pre", "blockquote"), len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit(), b.tag in ("li", "dt", "dd", "td", "th", "option")
    out[1:, 8:10], out[:-1, 10:12] = out[:-1, 0:2], out[1:, 0:2]
    out[2:, 12], out[:-2, 13] = out[:-2, 0], out[2:, 0]
    out[:, 14] = np.maximum(out[:, 8], out[:, 10])
    return out


@dataclass
class Looks:
    """The classifier's weights, and its constant."""

    weights: np.ndarray
    constant: float

    def of(self, page: list[Block]) -> np.ndarray:
        return np.clip(looks(page) @ self.weights + self.constant, -LOOKS, LOOKS)


#: For tables without a page that tells: long blocks, sentences and paragraphs are content, links and list items aren't.
PLAIN = Looks(np.array([0.9, -4.0, 0, 0.8, 0.5, 0.8, 1.0, -1.0, 0, 0, 0, 0, 0, 0, 0]), -3.5)


def fit(pages: DataFrame, html: str = "html") -> Looks:
    """A linear discriminant between blocks in articles and blocks in menus, margins, headers, footers and notices, on
    about SAMPLE pages that have both. Sums over classes are all that leaves the tasks; every page weighs the same."""

    def tally(cols: list[list]) -> Iterator[tuple]:
        total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for (h,) in zip(*cols, strict=True):
            page = blocks(h)
            own = np.array([b.content >= CONTENT and not b.boiler for b in page], bool)
            other = np.array([bool(b.boiler) or not b.content for b in page], bool)
            if own.any() and other.any():
                x = looks(page)
                for k, which in enumerate((other, own)):
                    part = x[which]
                    total[k] += np.concatenate(([1.0], part.mean(axis=0), (part.T @ part / len(part)).ravel()))
        for k in (0, 1):
            yield k, total[k].tolist()

    held = pages.select(F.col(html).alias("html")).where("html <> ''")
    n = held.count()
    drawn = F.pmod(F.xxhash64("html"), F.lit(1 << 40)) / (1 << 40)
    rows = map_rows(held.where(drawn < SAMPLE / max(n, SAMPLE)), tally, "k int, sums array<double>", 100)
    each = rows.select("k", F.posexplode("sums")).groupBy("k", "pos").agg(F.sum("col").alias("s")).collect()  # two rows a number
    sums = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for r in each:
        sums[r.k, r.pos] = r.s
    if not sums[:, 0].all():
        return PLAIN
    mean = sums[:, 1 : 1 + FEATURES] / sums[:, :1]
    square = (sums[:, 1 + FEATURES :] / sums[:, :1]).reshape(2, FEATURES, FEATURES)
    spread = sum(square[k] - np.outer(mean[k], mean[k]) for k in (0, 1)) / 2 + RIDGE * np.eye(FEATURES)
    weights = np.linalg.solve(spread, mean[1] - mean[0])
    # Sums come in any order: rounded, so that the last bits don't matter.
    return Looks(weights.round(4), float(round(-weights @ mean.sum(axis=0) / 2, 4)))


def prices(page: list[Block], model: Looks = PLAIN) -> list[tuple[float, float]]:
    """(as content, as boilerplate) of each block."""
    marked = any(b.content >= CONTENT and not b.boiler for b in page)
    out = []
    for b, x in zip(page, model.of(page).tolist(), strict=True):
        other = CONTENT if marked and not b.content else 0.0  # the page says where its article is
        out.append((b.content + max(0.0, x), b.boiler + other + max(0.0, -x)))
    return out


def ties(page: list[Block]) -> dict[tuple[int, int], float]:
    """The smoothness edges."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(page):
        if k and page[k - 1].landmark == b.landmark:
            edges[k - 1, k] = NEXT + SAME * (page[k - 1].parent == b.parent)
        j = last.get(b.parent)
        if j is not None and page[j].landmark == b.landmark:
            edges[j, k] = edges.get((j, k), 0) + SIBLING
        last[b.parent] = k
    return edges


def minimum_cut(terminal: list[tuple[float, float]], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut: capacities from the source and to the sink of each
    node, and undirected edges. Nodes whose terminals outweigh all their edges are settled beforehand; they are
    most; what is left is solved by augmenting paths, level by level (Dinic 1970)."""
    n = len(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    pull = [s - t for s, t in terminal]
    side: list[bool | None] = [None] * n
    todo = [v for v in range(n) if abs(pull[v]) >= sum(near[v].values())]
    while todo:
        v = todo.pop()
        if side[v] is not None:
            continue
        side[v] = pull[v] > 0
        for u, w in near[v].items():
            if side[u] is None:  # the edge to a settled node is one to its terminal
                pull[u] += w if side[v] else -w
                del near[u][v]
                if abs(pull[u]) >= sum(near[u].values()):
                    todo.append(u)
    free = [v for v in range(n) if side[v] is None]
    flow = {v: dict(near[v]) for v in free}
    source = {v: max(0.0, pull[v]) for v in free}
    sink = {v: max(0.0, -pull[v]) for v in free}
    while True:  # in each round all augmenting paths that lead from level to level
        level = {v: 0 for v in free if source[v] > TINY}
        queue = list(level)
        for v in queue:
            for u, w in flow[v].items():
                if w > TINY and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if not any(sink[v] > TINY for v in queue):
            return [v in level if side[v] is None else bool(side[v]) for v in range(n)]
        left = {v: list(flow[v]) for v in queue}  # ways not tried yet
        for begin in [v for v in queue if not level[v]]:
            path = [begin]
            while path and source[begin] > TINY:
                v = path[-1]
                if sink[v] > TINY:
                    steps = list(zip(path, path[1:], strict=False))
                    amount = min([source[begin], sink[v], *(flow[a][b] for a, b in steps)])
                    source[begin] -= amount
                    sink[v] -= amount
                    for a, b in steps:
                        flow[a][b] -= amount
                        flow[b][a] += amount
                    path = [begin]
                elif left[v]:
                    u = left[v][-1]
                    if flow[v][u] > TINY and level[u] == level[v] + 1:
                        path.append(u)
                    else:
                        left[v].pop()
                else:
                    path.pop()
                    if path:
                        left[path[-1]].pop()


def main_text(html: str | None, model: Looks = PLAIN) -> str:
    """The blocks labelled content, joined by two line ends; empty for null, empty and text-free pages."""
    page = blocks(html) if html else []
    kept = minimum_cut(prices(page, model), ties(page)) if page else []
    return "\n\n".join(b.text for b, good in zip(page, kept, strict=True) if good)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null, empty and text-free pages give the empty text. Pages are read whole, in linear time, however long; repeated rows
    come out alike, and null ids and urls pass through. Other columns are ignored. An empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, html))

    def work(cols: list[list]) -> Iterator[tuple]:
        for i, u, h in zip(*cols, strict=True):
            text = main_text(h, shared.value)
            yield i, u, text, len(text)

    return map_rows(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), work, "page_id long, url string, text string, n_chars long", 500)
