"""Byte-level BPE ids, and the attribution of tokens to the sections of a document."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import map_rows


class ByteBpe:
    """The ids that `tokenizers` gives for a byte-level BPE file with add_special_tokens=False: a special token's string in
    a text is that token.

    Another library of the same merges takes a quarter of the time. It can't take very long runs of white space; such
    texts go to `tokenizers` itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.size[i] = len(token)

    @cached_property
    def library(self):
        """Loaded only for a text that needs it: each worker would hold it for good."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        """uint32 ids."""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None) -> ByteBpe:
    """The encoder of a `tokenizers` file that is found on the executor, by default the public byte_bpe_50k.json."""
    import public_tokenizers

    return ByteBpe(path or public_tokenizers.path("byte_bpe_50k.json"))


def allocate(spans: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of gapless token spans with gapless section spans, both as end offsets in bytes.

    Returns each section's token count and how many of those cross into another section. A token that lies in
    several sections goes to the one that holds most of its bytes, the earliest of equals. Sections may be empty;
    they get none.
    """
    starts = np.concatenate(([0], spans[:-1]))
    begin = np.concatenate(([0], sections[:-1]))
    first = np.searchsorted(sections, starts, side="right")
    final = np.searchsorted(sections, spans, side="left")
    owner = first.copy()
    crossing = np.flatnonzero(final > first)
    for t in crossing:  # few: a token that spans a border
        held = [min(spans[t], sections[s]) - max(starts[t], begin[s]) for s in range(first[t], final[t] + 1)]
        owner[t] = first[t] + int(np.argmax(held))
    n = len(sections)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", fields: tuple[str, ...] = ("text",), border: str = "\n", vocabulary: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, field, section_no, start_char, end_char, n_tokens, n_crossing.

    The fields of a document are joined by the border string and encoded once, as a whole; within a field each
    border ends a section, and belongs to it. So every token of the document is counted in exactly one row. Null
    fields are empty; a document of null or empty fields has one empty section a field, without tokens. start_char
    and end_char are code points of the joined document. Repeated rows are counted each for itself, rows without id under
    a null id. A text is encoded whole, however long. Other columns are ignored. An empty table gives no rows.
    """

    def work(cols: list[list]) -> Iterator[tuple]:
        encode = byte_bpe(vocabulary)
        mark = border.encode()
        for doc, *values in zip(*cols, strict=True):
            parts = []  # (field, number, bytes)
            for k, (name, value) in enumerate(zip(fields, values, strict=True)):
                lines = (value or "").encode("utf-8", "surrogatepass").split(mark)
                last = len(lines) - 1
                parts += [(name, j, line + mark * (j < last or k < len(fields) - 1)) for j, line in enumerate(lines)]
            whole = b"".join(p[2] for p in parts)
            ends = np.cumsum([len(p[2]) for p in parts])
            chars = np.cumsum([len(p[2].decode("utf-8", "surrogatepass")) for p in parts])
            if whole:
                count, cross = allocate(np.cumsum(encode.size[encode(whole.decode("utf-8", "surrogatepass"))]), ends)
            else:
                count = cross = np.zeros(len(parts), np.int64)
            for (name, j, _), end, before, n, x in zip(parts, chars.tolist(), [0, *chars.tolist()], count.tolist(), cross.tolist(), strict=False):
                yield doc, name, j, before, end, n, x

    source = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)))
    return map_rows(source, work, "doc_id long, field string, section_no long, start_char long, end_char long, n_tokens long, n_crossing long")
