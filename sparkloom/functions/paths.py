"""File paths: one spelling per file, directories, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ODD_SPELLING = r"\\|//|^[./\s]|/\.|\s$|/$"


def _fold_parents(c: Column) -> Column:
    """Resolve '..' segments; those above the root vanish."""
    step = lambda acc, s: F.when(s != "..", F.array_append(acc, s)).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def _plain(c: Column, root: str) -> Column:
    """As plain_path, but blanks give an empty string. Clean spellings take a fast way out."""
    x = F.translate(F.regexp_replace(c, r"^\s+|\s+$", ""), "\\", "/")
    x = F.regexp_replace(x, r"/(?:\.?/)+", "/")
    x = F.regexp_replace(x, r"^(?:\./)+|/\.?$|^\.$", "")
    cut = lambda p: F.regexp_replace(p, rf"^/{root}(?:/|$)|^/", "")
    return F.when(~c.rlike(ODD_SPELLING), c).when(c.rlike(r"\.\."), _fold_parents(cut(x))).otherwise(cut(x))


def plain_path(c: Column, root: str = "workspace") -> Column:
    """The path relative to the checkout root ``/root``: trimmed, forward single slashes, no '.' or '..' parts.

    Null and blank paths, and the root itself, give null. Letter case is kept.
    """
    return F.nullif(_plain(c, root), F.lit(""))


def plain_paths(files: Column, root: str = "workspace") -> Column:
    """Sorted distinct plain paths of an array of spellings; blanks and nulls dropped, a null array gives an empty one."""
    kept = F.filter(F.transform(files, lambda p: _plain(p, root)), lambda p: p != "")
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def directory(c: Column) -> Column:
    """Everything before the last slash, '.' where there is none."""
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit("."))


def base_name(c: Column) -> Column:
    """The last segment."""
    return F.substring_index(c, "/", -1)
