"""Identifiers: splitting and naming styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capitals that no lower-case letter follows, or a word of lower-case letters with at most one capital before it.
WORD = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+"


def identifier_words(text: Column, shortest: int = 2) -> Column:
    """Lower-case words of the ASCII letter runs, broken at case changes; words under ``shortest`` letters dropped."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    return F.filter(words, lambda w: F.length(w) >= shortest)
