"""Hashes of texts that other tools can compute as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(text: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of SHA-256; null stays null."""
    return F.substring(F.sha2(text.cast("string"), 256), 1, digits)


def rolling31(text: Column) -> Column:
    """h = 31·h + character, kept to 32 bits, as an unsigned number; characters by code point, null as empty."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))


def xorshift32(state: Column) -> Column:
    """The next state of the 32-bit generator of shifts 13, 17 and 5; 0 is taken as 1."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    x = F.when(state.bitwiseAND(mask) == 0, F.lit(1)).otherwise(state.bitwiseAND(mask)).cast("bigint")
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(mask)
