"""Arrays: pairs, similarity, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs_of(items: Column) -> Column:
    """All (a, b) of a sorted array with a before b; meant for arrays of bounded size."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def smoothed_jaccard(a: Column, b: Column, smoothing: float = 1.0) -> Column:
    """(shared + s) / (all + 2s)."""
    return (F.size(F.array_intersect(a, b)) + smoothing) / (F.size(F.array_union(a, b)) + 2 * smoothing)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the longer array's rest counts as nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def all_finite(a: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    return a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
