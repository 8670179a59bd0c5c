"""The separator and the terminator of texts, and small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR, TERMINATOR = "\ue000", "\ue001"
PREVIEW = 32


def is_separator(symbol: Column) -> Column:
    return F.coalesce(symbol == F.lit(SEPARATOR), F.lit(False))


def is_terminator(symbol: Column) -> Column:
    return F.coalesce(symbol == F.lit(TERMINATOR), F.lit(False))


def visible(text: Column) -> Column:
    """The text with its separators as # and its terminators as $; a null as the empty text."""
    return F.coalesce(F.translate(text, SEPARATOR + TERMINATOR, "#$"), F.lit(""))


def sort_key(suffix: Column) -> Column:
    """A key in whose byte order the terminator comes first, then the separator, then all else; the lowest characters step aside for them."""
    return F.translate(F.regexp_replace(suffix, "([\u0000-\u0002])", "\u0002$1"), TERMINATOR + SEPARATOR, "\u0000\u0001")


def failure_table(pattern: str) -> list[int]:
    """For each beginning of the pattern, how long its longest proper beginning is that also ends it."""
    out = [0] * len(pattern)
    k = 0
    for i in range(1, len(pattern)):
        while k and pattern[k] != pattern[i]:
            k = out[k - 1]
        k += pattern[k] == pattern[i]
        out[i] = k
    return out


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def placement(text: Column, partitions: int) -> Column:
    """A partition by the polynomial of base 31 over the text's characters, in 32 bits."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))
    return F.pmod(F.abs(total), F.lit(partitions)).cast("int")
