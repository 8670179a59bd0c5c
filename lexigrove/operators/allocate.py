"""Prefixes into groups of near-equal load, for the driver: a prefix table has a row for each F_m suffixes or so, not for each text."""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_fit_bins(frequencies: list[int], capacity: int) -> int:
    """Bins that best fit fills with the frequencies in the order given: each goes where the least room is left over, else into a new one."""
    room: list[tuple[int, int]] = []  # sorted by (room, number)
    made = 0
    for f in frequencies:
        at = bisect.bisect_left(room, (f, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, made
            made += 1
        bisect.insort(room, (left - f, number))
    return made


def balance(frequencies: list[int], groups: int, capacity: int) -> list[int] | None:
    """A group for each frequency: the least loaded, the first among equals; None if even that one has no room."""
    heap = [(0, g) for g in range(groups)]
    out = []
    for f in frequencies:
        load, g = heap[0]
        if load + f > capacity:
            return None
        heapq.heapreplace(heap, (load + f, g))
        out.append(g)
    return out


def group_count(frequencies: list[int], capacity: int, workers: int) -> int:
    bins = best_fit_bins(frequencies, capacity)
    return bins if bins < workers else -(-bins // workers) * workers


def assign(frequencies: list[int], limit: int, workers: int) -> tuple[list[int], int]:
    """A group for each of the frequencies, which fall, and the number of groups; where balancing fails with as many groups as best fit needs, another is added.

    There may be groups without a prefix, as their number is brought up to a multiple of the workers'.
    """
    capacity = max(limit, 1)
    if any(f > capacity for f in frequencies):
        raise ValueError("a prefix is over the limit")
    if not frequencies:
        return [], 0
    groups = group_count(frequencies, capacity, workers)
    while (found := balance(frequencies, groups, capacity)) is None:
        groups += 1
    return found, groups


def allocated(prefixes: DataFrame, limit: int, workers: int) -> tuple[DataFrame, int]:
    """allocate(), and the number of groups, those without a prefix too."""
    rows = prefixes.select("prefix", "frequency", "length").orderBy(F.desc("frequency"), "prefix").collect()
    where, groups = assign([r.frequency for r in rows], limit, workers)
    table = [(r.prefix, r.frequency, r.length, g, g // workers) for r, g in zip(rows, where, strict=True)]
    return prefixes.sparkSession.createDataFrame(table, "prefix string, frequency long, length int, group_id int, round_id int"), groups


def allocate(prefixes: DataFrame, limit: int, workers: int) -> DataFrame:
    """(prefix, frequency, length, group_id, round_id): the prefixes, most frequent first (ties by prefix), in groups of at most limit; rounds have a group for each worker.

    Their table meets on the driver: with the limit of the sizing rule it has a few rows for each 50th part of the corpus, however large that is.
    """
    return allocated(prefixes, limit, workers)[0]


def group_totals(assigned: DataFrame, groups: int | None = None, workers: int = 1) -> DataFrame:
    """(display_index, group_id, round_id, total_frequency, prefix_count) of each group that has a prefix; given the number of groups, of the others too, with 0 and 0."""
    totals = assigned.groupBy("group_id", "round_id").agg(F.sum("frequency").alias("total_frequency"), F.count("*").alias("prefix_count"))
    if groups is not None:
        numbered = assigned.sparkSession.range(groups).select(F.col("id").cast("int").alias("group_id"), F.floor(F.col("id") / workers).cast("int").alias("round_id"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        totals = numbered.join(totals.drop("round_id"), "group_id", "left").select("group_id", "round_id", zero("total_frequency"), zero("prefix_count"))
    return totals.select((F.col("group_id") + 1).alias("display_index"), "group_id", "round_id", "total_frequency", "prefix_count")


def group_stats(assigned: DataFrame, groups: int) -> DataFrame:
    """One row: group_count, prefix_count, and prefixes_per_group, their average to 2 digits (0 without groups)."""
    return assigned.agg(F.lit(groups).alias("group_count"), F.count("*").alias("prefix_count"), F.round(F.count("*") / F.lit(max(groups, 1)), 2).alias("prefixes_per_group"))
