"""Records of how a suffix differs from the one it was compared with: (char, range, offset), offset being their common prefix.

char: the other's character behind that; range: up to so many of the suffix's own characters from there on. Where one of the two ends there, char is U+0000 and range empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import sort_key

RANGE = 32
TYPE = "struct<char: string, range: string, offset: int>"


def record(suffix: Column, other: Column, common: Column, size: int = RANGE) -> Column:
    """The record of a suffix against another; both may be cut behind common + size characters."""
    ended = (F.length(suffix) <= common) | (F.length(other) <= common)
    char = F.when(ended, F.lit("\0")).otherwise(F.substring(other, common + 1, F.lit(1)))
    own = F.when(ended, F.lit("")).otherwise(F.substring(suffix, common + 1, F.lit(size)))
    return F.struct(char.alias("char"), own.alias("range"), common.cast("int").alias("offset"))


def first_record(suffix: Column, size: int = RANGE) -> Column:
    """The record of the first suffix of all: its beginning."""
    return F.struct(F.lit("\0").alias("char"), F.substring(suffix, F.lit(1), F.lit(size)).alias("range"), F.lit(0).alias("offset"))


def compare(a: Column, record_a: Column, b: Column, record_b: Column) -> Column:
    """(smaller, larger, record) of two suffixes, given their places and their records against one that comes before both.

    The one with more in common comes first, and the other keeps its record. With as much in common, the ranges decide, and the larger one's record is against the
    smaller. Ranges that agree as far as both go decide nothing: a counts as smaller, and the offset is negative.
    """
    range_a, range_b, offset_a, offset_b = record_a["range"], record_b["range"], record_a["offset"], record_b["offset"]
    most = F.least(F.length(range_a), F.length(range_b))
    differ = lambda k: F.substring(range_a, k, F.lit(1)) != F.substring(range_b, k, F.lit(1))
    places = F.filter(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), differ)
    at = F.get(places, F.lit(0))
    a_first = sort_key(F.substring(range_a, at, F.lit(1))) < sort_key(F.substring(range_b, at, F.lit(1)))

    def found(smaller: Column, larger: Column, char: Column, own: Column, offset: Column) -> Column:
        return F.struct(smaller.alias("smaller"), larger.alias("larger"), F.struct(char.alias("char"), own.alias("range"), offset.cast("int").alias("offset")).alias("record"))

    def rest(text: Column) -> Column:
        return F.substring(text, at, F.length(text))

    def kept(x: Column) -> tuple[Column, Column, Column]:
        return x["char"], x["range"], x["offset"]

    return (
        F.when(offset_a > offset_b, found(a, b, *kept(record_b)))
        .when(offset_a < offset_b, found(b, a, *kept(record_a)))
        .when(at.isNull(), found(a, b, F.lit("\0"), F.lit(""), -(most + offset_a)))
        .when(a_first, found(a, b, F.substring(range_a, at, F.lit(1)), rest(range_b), offset_a + at - 1))
        .otherwise(found(b, a, F.substring(range_b, at, F.lit(1)), rest(range_a), offset_b + at - 1))
    )
