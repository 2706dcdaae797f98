"""Shell commands as they appear in tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_command(c: Column) -> Column:
    """Program and operands in order, single spaces between.

    Options, NAME=value settings in front, and all from the first pipe, redirection, ``&&`` or ``;`` on are left out.
    Null gives an empty string.
    """
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)(?:\||&&|;|(?:(?<!\S)\d+|&)?[<>]).*$", "")
    x = F.regexp_replace(x, r"(?<!\S)-\S*", "")
    x = F.regexp_replace(x, r"^\s*(?:[A-Za-z_]\w*=\S*(?:\s+|$))+", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))
