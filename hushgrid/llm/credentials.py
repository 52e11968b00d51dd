"""Secrets in texts: strong ones by their look, weak ones only where the parts of a credential lie together.

A credential has an access identifier, a secret and often an endpoint. Each kind of span plays one of these roles. Strong
kinds are reported as they are; a weak candidate (a user name, a key of few signs, a long mixed token, an address) is reported
only if a part of a complementary role lies in its scope: at most REACH code points away and in the same section, which
ends at a blank line. Scopes and parts are joined as intervals in the task that holds the text: either side is sorted, and a
candidate meets the nearest part before it and the nearest after it, so many parts don't make many pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .batches import map_rows

#: Code points between a weak candidate and a part that makes it credible, at most.
REACH = 200
#: The roles that make a weak candidate of a role credible.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}


def either(words: str) -> str:
    """A pattern of words, ASCII letters in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


def assigned(words: str, value: str) -> str:
    return rf"""({either(words)})["']?\x20*[:=]\x20*["']?({value})"""


@dataclass(frozen=True)
class Kind:
    """Spans of a pattern whose checked group has `least` code points and matches all of `having`. runs: the characters of
    a pattern that are runs of one class; words: what a text must hold, in small letters. Both save work only."""

    name: str
    role: str
    strong: bool
    pattern: str
    group: int = 0
    least: int = 1
    having: tuple[str, ...] = ()
    runs: str = ""
    words: tuple[str, ...] = ()


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: In the order of equal starts. The patterns mean the same to Python and to SQL engines.
KINDS = [
    Kind("assign", "secret", True, assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), 2, 6, words=("passw", "secret", "token", "api")),
    Kind("access", "identifier", True, "AKIA[A-Z0-9]+", 0, 20, words=("akia",)),
    Kind("hex", "secret", True, "[0-9a-f]{24,}", 0, 24, runs=_DIGITS + "abcdef"),
    Kind("login", "identifier", False, assigned("user|user_?name|login|account|client_?id|key_?id", "[A-Za-z0-9@._-]+"), 2, 3, words=("user", "login", "account", "client", "key")),
    Kind("keyid", "identifier", False, "[A-Z0-9]{16,}", 0, 16, ("[A-Z]", "[0-9]"), runs=_UPPER + _DIGITS),
    Kind("key", "secret", False, assigned("pwd|pass|auth|credentials?|key", "[A-Za-z0-9+/_.=-]+"), 2, 6, ("[0-9]",), words=("pwd", "pass", "auth", "credential", "key")),
    Kind("mixed", "secret", False, "[A-Za-z0-9+/_=-]{20,}", 0, 20, ("[a-z]", "[A-Z]", "[0-9]"), runs=_LOWER + _UPPER + _DIGITS + "+/_=-"),
    Kind("host", "endpoint", False, assigned("host|host_?name|server|endpoint|url|uri", "[A-Za-z0-9._:/-]+"), 2, 4, ("[.]",), words=("host", "server", "endpoint", "url", "uri")),
    Kind("address", "endpoint", False, r"""(https?|s?ftp|ssh|postgres|postgresql|mysql|redis|amqp|mongodb)://[^\x00-\x20"'<>\x7F]+""", words=("://",)),
]
BREAK = r"\n[\x20\t\r]*\n"

Span = tuple[str, int, int]


class Scanner:
    """Finds the spans of all kinds. A kind's pattern is tried only on texts that can hold it."""

    def __init__(self, kinds: list[Kind] = KINDS) -> None:
        self.kinds = kinds
        self.pattern = {k.name: re.compile(k.pattern) for k in kinds}
        self.having = {k.name: [re.compile(h) for h in k.having] for k in kinds}
        # Characters of a run become `r`, all others a blank: a run is then found as a plain substring.
        self.table = {k.name: bytes(ord("r") if chr(c) in k.runs else 32 for c in range(256)) for k in kinds if k.runs}
        self.words = {k.name: tuple(w.encode() for w in k.words) for k in kinds}

    def candidates(self, text: str) -> dict[str, list[tuple[int, int]]]:
        raw = text.encode("utf-8", "surrogatepass")
        small, out = raw.lower(), {}
        assigns = b"=" in raw or b":" in raw
        for k in self.kinds:
            if k.runs:
                possible = b"r" * k.least in raw.translate(self.table[k.name])
            else:
                possible = (assigns or not k.group) and any(w in small for w in self.words[k.name])
            if possible:
                fit = lambda s, k=k: len(s) >= k.least and all(h.search(s) for h in self.having[k.name])
                out[k.name] = [m.span() for m in self.pattern[k.name].finditer(text) if fit(m[k.group])]
        return out

    def __call__(self, text: str, reach: int = REACH) -> list[Span]:
        """(kind, start, end) by start, then kind: strong spans, and weak ones that are linked and overlap no strong one."""
        found = self.candidates(text)
        strong = {k.name for k in self.kinds if k.strong}
        spans: list[Span] = [(n, a, b) for n, held in found.items() if n in strong for a, b in held]
        weak = {n: held for n, held in found.items() if n not in strong and held}
        if weak:
            sure = Intervals([(a, b) for _, a, b in spans])
            weak = {n: [s for s in held if not sure.overlaps(*s)] for n, held in weak.items()}
            role = {k.name: k.role for k in self.kinds}
            parts = {r: Intervals([s for n in found if role[n] == r for s in weak.get(n, found[n] if n in strong else [])]) for r in COMPLEMENTS}
            breaks = [m.start() for m in re.finditer(BREAK, text)]
            for n, held in weak.items():
                spans += [(n, a, b) for a, b in held if any(parts[r].within(a, b, reach, breaks) for r in COMPLEMENTS[role[n]])]
        order = {k.name: i for i, k in enumerate(self.kinds)}
        return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


class Intervals:
    """Spans sorted by start and by end."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = sorted(a for a, _ in spans), sorted(b for _, b in spans)

    def overlaps(self, a: int, b: int) -> bool:
        """Whether a span has a code point in [a, b): more have begun before b than have ended by a."""
        return bisect_left(self.starts, b) > bisect_right(self.ends, a)

    def within(self, a: int, b: int, reach: int, breaks: list[int]) -> bool:
        """Whether a span beside [a, b) is at most `reach` away, without a break between."""
        i, j = bisect_left(self.starts, b), bisect_right(self.ends, a) - 1
        close = lambda x, y: y - x <= reach and bisect_left(breaks, x) == bisect_left(breaks, y)
        return (i < len(self.starts) and close(b, self.starts[i])) or (j >= 0 and close(self.ends[j], a))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH, kinds: list[Kind] | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, role, strong, start, end>>: of each row, by start, then kind as in KINDS.

    Positions are code points, the end exclusive. A null text is empty and has no spans. Repeated rows are scanned each for
    itself, a null id is kept. Texts are scanned whole, in linear time. Other columns are ignored. An empty table gives no
    rows. Nothing is shuffled.
    """
    wanted = kinds or KINDS

    def work(cols: list[list]) -> Iterator[tuple]:
        scanner = Scanner(wanted)
        of = {k.name: (k.role, k.strong) for k in wanted}
        for i, t in zip(*cols, strict=True):
            yield i, [{"kind": n, "role": of[n][0], "strong": of[n][1], "start": a, "end": b} for n, a, b in scanner(t or "", reach)]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {id_type}, spans array<struct<kind: string, role: string, strong: boolean, start: bigint, end: bigint>>")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the strong spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    strong = F.filter("spans", lambda s: s["strong"])
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(listed(strong).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    finds = []
    for i, k in enumerate(KINDS):
        p = quoted(k.pattern)
        checks = "".join(f" AND regexp_matches(regexp_extract(m, {p}, {k.group}), {quoted(h)})" for h in k.having)
        finds.append(f"""SELECT r, '{k.name}' AS kind, {i} AS nr, '{k.role}' AS role, {k.strong} AS strong, a, a + length(m) AS b
            FROM (SELECT r, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS a
                FROM (SELECT r, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM docs) WHERE len(m) > 0)
            WHERE length(regexp_extract(m, {p}, {k.group})) >= {k.least}{checks}""")
    brk = quoted(BREAK)
    fits = " OR ".join(f"(c.role = '{r}' AND o.role IN ({', '.join(map(quoted, rs))}))" for r, rs in COMPLEMENTS.items())
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({' UNION ALL '.join(finds)}),
        parts AS (SELECT f.*, len(string_split_regex(t[1:a], {brk})) AS section FROM found f JOIN docs USING (r)
            WHERE strong OR NOT EXISTS (FROM found s WHERE s.r = f.r AND s.strong AND s.a < f.b AND s.b > f.a)),
        spans AS (SELECT r, kind, nr, a, b, strong FROM parts c WHERE strong OR EXISTS (FROM parts o WHERE o.r = c.r AND o.section = c.section AND ({fits})
            AND ((o.a >= c.b AND o.a - c.b <= {REACH}) OR (o.b <= c.a AND c.a - o.b <= {REACH})))),
        lists AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, nr, b) FILTER (strong) AS base, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, nr, b) AS spans FROM spans GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN lists USING (r)"""


#: The same result by joins over spans that DuckDB finds.
SQL = _sql()
