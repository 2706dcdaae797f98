"""Words of free text and of identifiers for retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default stop words of queries; callers may pass their own.
STOP_WORDS = "the and for with from this that use get set add new how why what when where does not are was has can all any into out our your its".split()


def words(text: Column, shortest: int = 3) -> Column:
    """Lower-case runs of ASCII letters and digits of at least ``shortest`` characters; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= shortest)


def split_case(part: Column) -> Column:
    """Parts of an identifier at case changes, before the last of several capitals included; case kept."""
    spaced = F.regexp_replace(F.regexp_replace(part, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def identifier_terms(text: Column, stop: list[str] = STOP_WORDS, shortest: int = 2) -> Column:
    """Terms of identifiers: case-split lower-case words without stop words; where one was dropped, the joined identifier too."""
    banned = F.array(*[F.lit(w) for w in stop])

    def of_part(part: Column) -> Column:
        camel = split_case(part)
        valid = F.filter(F.transform(camel, F.lower), lambda w: F.length(w) >= shortest)
        kept = F.filter(valid, lambda w: ~F.array_contains(banned, w))
        whole = F.lower(part)
        joined = (F.size(camel) > 1) & (F.size(kept) < F.size(valid)) & (F.length(whole) >= 4) & ~F.array_contains(banned, whole)
        return F.concat(kept, F.when(joined, F.array(whole)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]+"), of_part))


def query_terms(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct terms of a query."""
    return F.array_distinct(identifier_terms(text, stop))
