"""Corpus encoding with a public byte-level BPE vocabulary, by a backtracking encoder.

A text is cut into pieces by the vocabulary's own pattern. Of a piece an Aho-Corasick automaton over all tokens gives, in
one pass, the longest token that starts at each byte. The encoder walks from left to right, takes the longest token,
and keeps it if it may stand beside the token before it: two tokens are compatible if merging them in rank order would
not have joined bytes across their border earlier. Otherwise it tries the next shorter prefix token, and where none is
left it steps back; positions found to be dead are never entered again, so the work is linear in the bytes. The result
is exactly that of merging pair by pair in rank order. Decoding reads slices of one byte string through an offset table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the public vocabulary's pattern for pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only, where the standard library's faster engine will do.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, and the longest of them; when full the memory starts anew.
MEMORY, LONGEST_KEPT = 200_000, 64
#: Ids of empty and of null texts: none.
EMPTY: list[int] = []


def _byte_of_symbol() -> dict[str, int]:
    """The vocabulary writes each byte as one printable character: itself where it is one, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Tables of one vocabulary, and the ids of texts. ``pieces`` remembers the ids of short pieces."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_of_symbol()
        plain = lambda token: "".join(chr(to_byte[c]) for c in token)  # noqa: E731  bytes as the characters U+0000..U+00FF
        self.ids = {plain(t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        self.text = {i: t for t, i in self.ids.items()}
        size = max(self.text) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.born = [-1] * size  # at which merge a token arises; single bytes before all merges
        for n, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            left, right = self.ids[plain(a)], self.ids[plain(b)]
            whole = self.ids[plain(a + b)]
            self.rank[left, right] = n
            if self.halves[whole] is None:
                self.halves[whole], self.born[whole] = (left, right), n
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
            for k in range(len(t) - 1, 0, -1):
                if (p := self.ids.get(t[:k])) is not None:
                    self.shorter[i] = p
                    break
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.cut, self.cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        raw = [self.text.get(i, "").encode("latin-1") for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.blob = b"".join(raw)

    def _may_meet(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undoing merges from both sides, latest first, no pair across the border merges sooner."""
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        left, right, bound, answer = a, b, len(self.rank), True
        while True:
            n = self.rank.get((left, right))
            if n is not None and n < bound:
                answer = False
                break
            # the later born of the two faces is undone; equals: the right one, as the left merge happens first
            if self.born[left] > self.born[right]:
                bound = self.born[left]
                left = self.halves[left][1]
            elif self.born[right] >= 0:
                bound = self.born[right] + 1
                right = self.halves[right][0]
            else:
                break
        if len(self.compatible) > 4 * MEMORY:
            self.compatible.clear()
        self.compatible[a, b] = answer
        return answer

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        if (whole := self.ids.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        longest = [-1] * n
        size = [0] * n
        for end, (length, token) in self.automaton.iter(raw):
            if length > size[at := end - length + 1]:
                longest[at], size[at] = token, length
        text, shorter = self.text, self.shorter
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + len(text[token])
                if alive[end] and (last < 0 or self._may_meet(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                alive[at] = 0
                out.pop()
                at -= len(text[last])
                token = shorter[last]
                while token < 0:  # nothing shorter starts here either
                    alive[at] = 0
                    last = out.pop()
                    at -= len(text[last])
                    token = shorter[last]
                break
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; EMPTY for empty and null texts."""
        if not text:
            return EMPTY
        pieces, out = self.pieces, []
        for p in self.cut_ascii(text) if text.isascii() else self.cut(text):
            got = pieces.get(p)
            if got is None:
                got = self._piece(p)
                if len(p) <= LONGEST_KEPT:
                    if len(pieces) >= MEMORY:
                        pieces.clear()
                    pieces[p] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by slices of the byte string."""
        o = self.offsets
        return b"".join(self.blob[o[i] : o[i + 1]] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a worker process, built once."""
    return Encoder(f"{folder}/{vocabulary}.json")


def encoded(texts: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) for every row: ids of ``text``, an empty list for an empty or null one.

    Rows stay in their partition and are encoded batch by batch; nothing is shuffled. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for b in batches:
            for some in _slices(b):
                lists = [own.encode(t) for t in some.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _slices(batch: pa.RecordBatch, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Short slices, so that the lists of a batch of long texts are not all held at once."""
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def token_counts(texts: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) for every row, without handing the ids back to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for b in batches:
            counts = [len(own.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decoded(ids: DataFrame, key: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of (key, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for b in batches:
            texts = [None if x is None else own.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    ship(ids.sparkSession)
    kind = ids.schema[key].dataType.simpleString()
    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
