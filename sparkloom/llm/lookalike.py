"""Visually identical text with different characters: one consistent form, and texts that only look the same.

Words are read by a weighted edit automaton over a trie of vocabulary spellings. Replacing a character by one that is drawn
alike, spelling it out, taking its accent apart and passing over one without a mark of its own cost nothing; every other
edit costs 1. A word within the allowed cost (0 by default) takes the vocabulary's spelling, in the script the vocabulary
writes it in: a Russian word typed with some Latin letters becomes the Russian word. Of several spellings with one
look the ASCII one holds, else the first of the vocabulary. All else is normalised character by character by a table.
Since the spelling depends only on the look, texts have one canonical form exactly if their looks are equal.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable, join_stats, ship
from .bpe import TOKENIZERS, VOCABULARY
from .cooccur import CHUNK, chunk_products

#: Letters of other scripts drawn like Latin ones, and Cyrillic ones drawn like Greek ones.
ALIKE = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУҮХԌԚԜӀѴаеѕіјорсухһԁԛԝӏѵү", "ABESIJKMHOPCTYYXGQWIVaesijopcyxhdqwlvy"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονρϲϳ", "ABEZHIKMNOPTYXCJovpcj"),
    "Cyrillic as Greek": ("ГПФ", "ΓΠΦ"),
    "Latin": ("ɡ", "g"),
}
#: Characters written by two or more that look the same, besides wide and narrow forms.
SPELLED_OUT = [(0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xB5, 0xB5)]
#: Drawn as nothing though not format characters, and format characters that do show.
BLANK = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
SHOWN = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]

_LATIN = {ord(a): b for source, target in ALIKE.values() for a, b in zip(source, target, strict=True)}
_within = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)


class _Plain(dict):
    """str.translate table, filled on demand: what a character stands for before accents are taken apart."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        form = unicodedata.decomposition(ch)
        if _within(cp, BLANK) or kind == "Cf" and not _within(cp, SHOWN) or kind == "Cc" and ch not in "\t\n":
            out = ""
        elif kind == "Zs":
            out = " "
        elif kind in ("Zl", "Zp"):
            out = "\n"
        elif form.startswith(("<wide>", "<narrow>")) or _within(cp, SPELLED_OUT):
            out = unicodedata.normalize("NFKC", ch)
        else:
            out = ch
        self[cp] = out
        return out


_PLAIN = _Plain()


def by_table(text: str) -> str:
    """The text with every character in its plain form: widths, ligatures, spaces, accents, look-alikes, ignorables."""
    apart = unicodedata.normalize("NFD", text.translate(_PLAIN))
    return unicodedata.normalize("NFC", apart.translate(_LATIN))


class _Moves(dict):
    """The labels that a character walks along at no cost: none for an ignorable, several for a ligature or an accented letter."""

    def __missing__(self, ch: str) -> str:
        out = self[ch] = unicodedata.normalize("NFD", ch.translate(_PLAIN)).translate(_LATIN)
        return out


_MOVES = _Moves()


def _labels(word: str) -> Iterator[str]:
    """The labels of a word in canonical order: marks on one letter are sorted by class, also across ignorables between them."""
    marks: list[str] = []
    for ch in word:
        for c in _MOVES[ch]:
            if unicodedata.combining(c):
                marks.append(c)
                continue
            if marks:
                yield from sorted(marks, key=unicodedata.combining)
                marks.clear()
            yield c
    yield from sorted(marks, key=unicodedata.combining)


class SpellingTrie:
    """Spellings of a vocabulary by their look; ``match`` runs the edit automaton over it. Earlier words come before later ones."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        for w in words:
            node, look = self.root, w if w.isascii() else "".join(_labels(w))
            for c in look:
                node = node.setdefault(c, {})
            node.setdefault("", look if look.isascii() else unicodedata.normalize("NFC", w))

    def _open(self, states: dict[int, tuple[float, dict]], budget: float) -> dict[int, tuple[float, dict]]:
        """States with those reached by letters of the vocabulary that the word lacks."""
        todo = list(states.values())
        while todo:
            cost, node = todo.pop()
            if cost + 1 <= budget:
                for label, m in node.items():
                    if label and (id(m) not in states or cost + 1 < states[id(m)][0]):
                        states[id(m)] = (cost + 1, m)
                        todo.append(states[id(m)])
        return states

    def match(self, word: str, budget: float = 0.0) -> str | None:
        """The cheapest vocabulary spelling of ``word`` within ``budget``, the first in alphabetical order among equals."""
        states = self._open({id(self.root): (0.0, self.root)}, budget)
        for c in _labels(word):
            reached: dict[int, tuple[float, dict]] = {}
            for cost, node in states.values():
                steps = [(cost, node[c])] if c in node else []
                if cost + 1 <= budget:
                    steps += [(cost + 1, node)] + [(cost + 1, m) for label, m in node.items() if label and label != c]
                for k, n in steps:
                    if id(n) not in reached or k < reached[id(n)][0]:
                        reached[id(n)] = (k, n)
            if not reached:
                return None
            states = self._open(reached, budget)
        ends = [(k, n[""]) for k, n in states.values() if "" in n]
        return min(ends)[1] if ends else None


#: The public vocabulary of many languages whose words are spellings besides those of VOCABULARY.
MANY_LANGUAGES = "byte_bpe_multi_50k"


@lru_cache(maxsize=2)
def spellings(folder: str = TOKENIZERS) -> SpellingTrie:
    """The whole words of public vocabularies that consist of letters: a fixed list, independent of the data."""
    with open(f"{folder}/{VOCABULARY}.json", encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    words = [t[1:] for t in tokens if t.startswith("Ġ") and t[1:].isascii()]
    with open(f"{folder}/{MANY_LANGUAGES}.tiktoken", "rb") as f:
        raw = [base64.b64decode(line.split()[0]) for line in f]
    words += [t[1:].decode("utf-8", "ignore") for t in raw if t[:1] == b" " and not t.isascii()]
    return SpellingTrie(w for w in words if len(w) > 1 and regex.fullmatch(r"[\p{L}\p{M}]+", w))


_ODD_ASCII = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
#: A run of letters, marks and characters that may be drawn as nothing, with one beyond ASCII: what is replaced alike never starts or ends such a run.
_IN_WORD = r"\p{L}\p{M}\p{Nl}\p{Cf}\x00-\x08\x0b-\x1f\x7f-\x9f\U000E0000-\U000E0FFF"
_PLAIN_IN_WORD = r"A-Za-z\x00-\x08\x0b-\x1f\x7f"
_WORD = regex.compile(rf"(?<![{_PLAIN_IN_WORD}])[{_PLAIN_IN_WORD}]*+[[{_IN_WORD}]--[\x00-\x7f]][{_IN_WORD}]*+", regex.V1)
#: Marks and ignorables in front of the first letter belong to what stands before them.
_LEAD = regex.compile(r"[\p{M}\p{Cf}\x00-\x08\x0b-\x1f\x7f-\x9f\u115f\u1160\u3164\uffa0\U000E0000-\U000E0FFF]*+", regex.V1)
_SHOWS = regex.compile(r"[^\p{Z}\p{Cc}\p{Cf}\p{Cs}\s⠀]")
_MEMORY = 100_000


class Canonicaliser:
    """Canonical form of texts; remembers the words it has looked up."""

    def __init__(self, trie: SpellingTrie, budget: float = 0.0) -> None:
        self.trie, self.budget, self.known = trie, budget, {}

    def _spelled(self, word: str) -> str | None:
        if word not in self.known:
            if len(self.known) >= _MEMORY:
                self.known.clear()
            self.known[word] = self.trie.match(word, self.budget)
        return self.known[word]

    def canonical(self, text: str) -> str:
        """Plain ASCII text is its own form; otherwise words take the spelling the automaton finds, and what is between them goes through the table."""
        if text.isascii() and not _ODD_ASCII.search(text):
            return text
        out, at = [], 0
        for m in _WORD.finditer(text):
            first = _LEAD.match(text, m.start()).end()
            if (spelled := self._spelled(text[first : m.end()])) is not None:
                out += (self._between(text[at:first]), spelled)
                at = m.end()
        return "".join(out) + self._between(text[at:])

    def _between(self, text: str) -> str:
        return text if text.isascii() and not _ODD_ASCII.search(text) else by_table(text)


def shows(text: str) -> bool:
    """Whether a text has a visible character."""
    return bool(text) and any(not _within(ord(m[0]), BLANK) for m in _SHOWS.finditer(text))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_texts(texts: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """(key, canonical, changed) for every row; a null text stays null and unchanged. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Canonicaliser(spellings(folder))
        for b in batches:
            before = b.column(1).to_pylist()
            after = [None if t is None else own.canonical(t) for t in before]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(after, pa.string()), pa.array([x != y for x, y in zip(before, after, strict=True)])], names=[key, "canonical", "changed"])

    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, canonical string, changed boolean")


def looks(texts: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """(key, look, raw): 128-bit digests of the canonical and of the given text, for texts with a visible character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Canonicaliser(spellings(folder))
        for b in batches:
            keep = [(i, t) for i, t in enumerate(b.column(1).to_pylist()) if t and shows(t)]
            raw = [_digest(t) for _, t in keep]
            look = [r if (c := own.canonical(t)) is t else _digest(c) for (_, t), r in zip(keep, raw, strict=True)]
            keys = b.column(0).take(pa.array([i for i, _ in keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(look, pa.binary()), pa.array(raw, pa.binary())], names=[key, "look", "raw"])

    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, look binary, raw binary")


def _spelled_alike(rows: DataFrame, key: str) -> DataFrame:
    """(look, raw, n, least, spellings, size, class_id) of every spelling in a look with several; n rows have it, ``size`` the look."""
    spelled = durable(rows.groupBy("look", "raw").agg(F.count("*").alias("n"), F.min(key).alias("least")))
    several = spelled.groupBy("look").agg(F.count("*").alias("spellings"), F.sum("n").alias("size"), F.min("least").alias("class_id")).where("spellings > 1")
    return durable(join_stats(spelled, several, ["look"], "spellings", ["raw"]))


def lookalike_classes(texts: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """(key, class_id, links) of every row whose text differs from another of the same look.

    class_id is the least key of the rows with that look, links the number of rows with the look but another text. Rows of
    one text with a look of their own, however many, and texts without a visible character are left out. The size is
    that of the input; a hot spelling is salted, and no class is gathered.
    """
    rows = durable(looks(texts, key, text, folder))
    mixed = _spelled_alike(rows, key).select("raw", "n", "class_id", (F.col("size") - F.col("n")).alias("links"))
    return join_stats(rows.select(key, "raw"), mixed, ["raw"], "n", [key]).select(key, "class_id", "links")


def lookalike_pairs(texts: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """(a, b), a < b: keys of every two rows whose texts differ as strings but have one canonical form.

    The links of lookalike_classes one by one, for those who need the pairs themselves. Spellings of a look, not rows, are
    paired: they are dealt into pieces by hash, and the products of pieces are dealt out over tasks, as large baskets
    are. The rows of a spelling are attached with hot spellings salted; copies of one text are never paired.
    """
    rows = durable(looks(texts, key, text, folder))
    mixed = _spelled_alike(rows, key)
    # pieces by hash: half of CHUNK spellings on average, so that hardly any piece has more than CHUNK
    m = F.ceil(F.col("spellings") * 2 / CHUNK).cast("int")
    place = mixed.select("look", "raw", "n", F.when(F.col("spellings") <= CHUNK, 1).otherwise(m).alias("m")).withColumn("i", F.pmod(F.xxhash64("raw"), F.col("m")).cast("int"))
    pieces = durable(place.groupBy("look", "i", "m").agg(F.array_sort(F.collect_list(F.struct("raw", "n"))).alias("chunk")))
    crossed = chunk_products(pieces, ["look"]).select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y"))
    inside = pieces.select(F.explode("chunk").alias("x"), "chunk").select("x", F.explode("chunk").alias("y")).where("x.raw < y.raw")
    ordered = durable(crossed.unionByName(inside).select(F.col("x.raw").alias("raw"), F.col("y.raw").alias("partner"), F.col("x.n").alias("n"), F.col("y.n").alias("n_partner")))
    first = join_stats(rows.select(F.col(key).alias("x"), "raw"), ordered, ["raw"], "n", ["x"]).select("x", "partner")
    crowd = ordered.groupBy("partner").agg(F.sum("n").alias("weight"))
    members = join_stats(rows.select(F.col(key).alias("y"), F.col("raw").alias("partner")), crowd, ["partner"], "weight", ["y"])
    both = join_stats(first, members, ["partner"], "weight", ["x"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
