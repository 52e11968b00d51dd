"""Exact SentencePiece encoding of merge-type (BPE) models by backtracking.

A sequence of pieces is what the merges give if and only if each two neighbours, merged anew from their characters,
come out as the same two pieces. So a text is cut greedily by the longest piece that an Aho-Corasick automaton finds
at a place; neighbours that re-merge differently make it try the next shorter piece, or step back. A bitfield marks
the places from which every way failed, so none is tried twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from .batches import map_rows

SPACE = "▁"


class MergeEncoder(dict):
    """Encodes with the vocabulary and scores of a SentencePiece BPE model file.

    The model must keep texts as they are, but for the space mark and one mark put first, and have byte pieces.
    As a mapping it holds the ids of chunks that merges can't leave, at most `most` of them.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        import sentencepiece

        self.most, self.library = most, sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.library
        plain = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids) or m.unk_id() in self.bytes:
            raise ValueError("a model is wanted whose pieces hold the space mark only in front, no line ends, and byte pieces")
        if m.normalize(" a ﬁ  b ") != SPACE * 2 + "a ﬁ" + SPACE * 2 + "b" + SPACE:
            raise ValueError("a model is wanted that doesn't normalise")
        self.find = ahocorasick.Automaton()
        for p in self.ids:
            self.find.add_word(p, len(p))
        self.find.make_automaton()
        self.shorter = {p: next((k for k in range(len(p) - 1, 1, -1) if p[:k] in self.ids), 1) for p in self.ids if len(p) > 1}
        self.fits: dict[tuple[str, str], bool] = {}
        # Where no piece holds a letter with a sign behind it, no merge crosses there, and the sign begins a chunk.
        letter, sign = r"[^\W_¹²³]", rf"(?:[_¹²³]|[^\w{SPACE}\n])"
        if any(re.search(letter + sign, p) for p in self.ids):
            self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        else:
            self.chunks = re.compile(f"{SPACE}*{letter}+|{SPACE}*{sign}+{letter}*|\n|{SPACE}+").findall

    def merge(self, text: str) -> list[str]:
        """The merges themselves: the pair of the best score first, the leftmost of equals. For short strings."""
        out = list(text)
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = self.scores.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > self.most:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def cut(self, text: str) -> list[str]:
        """Pieces of one chunk; characters that are no piece stand alone."""
        longest = {end - size: size for end, size in self.find.iter(text)}  # by the place before the piece; the last is the longest
        shorter, fits = self.shorter, self.compatible
        at, n, failed, out = 0, len(text), 0, []
        size = longest.get(-1, 1)
        while at < n:
            while size and (failed and failed >> (at + size) & 1 or out and not fits(out[-1], text[at : at + size])):
                size = shorter.get(text[at : at + size], 0)
            if size:
                out.append(text[at : at + size])
                at += size
                size = longest.get(at - 1, 1)
            else:
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                size = shorter.get(last, 0)
        return out

    def __missing__(self, chunk: str) -> tuple[tuple[int, ...], str]:
        if len(self) >= self.most:
            self.clear()
        found = []
        for p in self.cut(chunk):
            i = self.ids.get(p)
            found += [i] if i is not None else [self.bytes[b] for b in p.encode("utf-8", "replace")]
        self[chunk] = known = (tuple(found), ",".join(map(str, found)))
        return known

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """Ids, and the same as decimals joined by commas."""
        if not text:
            return [], ""
        parts = list(map(self.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE))))
        return list(chain.from_iterable(p[0] for p in parts)), ",".join([p[1] for p in parts])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> MergeEncoder:
    import public_tokenizers

    return MergeEncoder(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, however long. Null and empty texts have none. Repeated rows and rows without
    id are kept as they come, other columns are ignored, and an empty table gives no rows."""

    def work(cols: list[list]) -> Iterator[tuple]:
        encode = encoder(model).encode
        return ((i, encode(t)[0]) for i, t in zip(*cols, strict=True))

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, ids array<int>", 500)


def decode_pieces(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text): the text of every array of ids, however long; empty for none or null. Repeated rows and rows without id
    are kept as they come, other columns are ignored, and an empty table gives no rows."""

    def work(cols: list[list]) -> Iterator[tuple]:
        decode = encoder(model).decode
        return ((i, decode(x) if x else "") for i, x in zip(*cols, strict=True))

    return map_rows(encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), work, "doc_id long, text string", 500)


def digest_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and rows without id are kept as
    they come. A line of any length is one piece of work, in linear memory. Other columns are ignored. An empty table
    gives no rows.
    """

    def work(cols: list[list]) -> Iterator[tuple]:
        own = encoder(model)
        for i, t in zip(*cols, strict=True):
            ids, listed = own.encode(t)
            yield i, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode() if ids else b"").hexdigest()

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 500)
