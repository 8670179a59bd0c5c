"""Windows over texts, their counts, and the discovery of prefixes of bounded frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..functions.symbols import SEPARATOR, TERMINATOR
from ..storage import cut

#: Texts are cut into parts of so many characters, and these again (overlapping by a window less one), as finding a character costs its distance from the start.
PARTS = (1 << 16, 128)
#: What no counted window has: line breaks, and U+FFFD in place of bytes that aren't text.
EXCLUDED = "[\r\n\ufffd]"
#: So many targets go along with the tasks that count.
FEW_TARGETS = 100_000


def windows(corpus: DataFrame, width: int, exclude_newlines: bool = True, targets: DataFrame | None = None, step: int = 1, compat: bool = False, short: bool = False) -> DataFrame:
    """(doc_id, pos, prefix): the windows of so many characters, from every place (from 0) of every text.

    exclude_newlines leaves out windows with a line feed, a carriage return, or the character that stands for bytes that aren't text. targets, (prefix), keeps the windows whose first width - step
    characters are in it. compat keeps only characters of one or three UTF-8 bytes at width 1. short: also the windows that the text's end cuts off.
    """
    places = F.length("text") if short else F.greatest(F.length("text") - (width - 1), F.lit(0))
    parts = corpus.select("doc_id", F.lit(0).alias("base"), "text", places.alias("own"))
    for size in PARTS:
        many = F.ceil(F.col("own") / size).cast("int")
        starts = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
        cuts = parts.select("doc_id", "base", "text", "own", F.explode(starts).alias("part"))
        rest = F.least(F.lit(size), F.col("own") - F.col("part") * size)
        parts = cuts.select("doc_id", (F.col("base") + F.col("part") * size).alias("base"), F.substring("text", F.col("part") * size + 1, F.lit(size + width - 1)).alias("text"), rest.alias("own"))
    places = parts.select("doc_id", "base", "text", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("p"))
    found = places.select("doc_id", (F.col("base") + F.col("p") - 1).cast("long").alias("pos"), F.substring("text", F.col("p"), F.lit(width)).alias("prefix"))
    if exclude_newlines:
        found = found.where(~F.col("prefix").rlike(EXCLUDED))
    if compat and width == 1:
        found = found.where(F.octet_length("prefix").isin(1, 3))
    if targets is not None:
        wanted = targets.select(F.col("prefix").alias("_wanted")).distinct()
        found = found.join(wanted, F.substring("prefix", 1, width - step) == F.col("_wanted"), "left_semi")
    return found


#: Numbers below this are counted in a table.
_TABLE = 1 << 22


def _distinct(ids: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, below bound; where each is first (in a table: somewhere), and how often it occurs."""
    if bound > _TABLE:
        return np.unique(ids, return_index=True, return_counts=True)
    n = np.bincount(ids, minlength=1)
    some = np.flatnonzero(n)
    where = np.empty(len(n), np.int64)
    where[ids] = np.arange(len(ids))
    return some, where[some], n[some]


def _among(ids: np.ndarray, some: np.ndarray, bound: int) -> np.ndarray:
    if bound > _TABLE:
        return np.isin(ids, some)
    table = np.zeros(bound, bool)
    table[some] = True
    return table[ids]


def _count(width: int, step: int, exclude_newlines: bool, compat: bool, targets: frozenset[str] | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 0)):
            texts = [t for t in part.column(0).to_pylist() if t]
            flat = "".join(texts)
            code = np.frombuffer(flat.encode("utf-32-le"), "<u4")
            places = len(code) - width + 1
            if places <= 0:
                continue
            length = np.array([len(t) for t in texts])
            ok = np.arange(width, len(code) + 1) <= np.repeat(np.cumsum(length), length)[:places]
            if exclude_newlines:
                newlines = np.concatenate([[0], np.cumsum((code == 10) | (code == 13) | (code == 0xFFFD))])
                ok &= newlines[width:] == newlines[:places]
            if compat and width == 1:
                ok &= (code < 0x80) | ((code >= 0x800) & (code < 0x10000))
            present = np.bincount(code) > 0
            dense = (np.cumsum(present) - 1)[code]
            at, bound = np.flatnonzero(ok), int(present.sum())
            kinds, ids = bound, dense[at]
            for k in range(1, width + 1):
                if targets is not None and k == width - step:
                    some, first, _ = _distinct(ids, bound)
                    keep = np.array([flat[p : p + k] in targets for p in at[first].tolist()], bool)
                    chosen = _among(ids, some[keep], bound)
                    at, ids = at[chosen], ids[chosen]
                if k == width:
                    break
                if bound * kinds >= 1 << 62:
                    ids = np.unique(ids, return_inverse=True)[1]
                    bound = max(1, len(ids))
                ids = ids * kinds + dense[at + k]
                bound *= kinds
            _, first, n = _distinct(ids, bound)
            yield pa.RecordBatch.from_arrays([pa.array([flat[p : p + width] for p in at[first].tolist()], pa.string()), pa.array(n, pa.int64())], ["prefix", "n"])

    return count


def window_counts(corpus: DataFrame, width: int, exclude_newlines: bool = True, targets: DataFrame | None = None, step: int = 1, compat: bool = False) -> DataFrame:
    """(prefix, frequency, length) of the windows: counts per part of the texts, then their sums.

    Counting in Arrow batches sends on distinct windows only; a row for each place costs ten times as much. Up to FEW_TARGETS targets are tested there too,
    more of them where the counts meet.
    """
    few = None
    if targets is not None and width > step:
        some = targets.select("prefix").distinct().limit(FEW_TARGETS + 1).collect()
        few = frozenset(r.prefix for r in some) if len(some) <= FEW_TARGETS else None
    counts = corpus.select("text").mapInArrow(_count(width, step, exclude_newlines, compat, few), "prefix string, n long")
    if targets is not None and few is None:
        wanted = targets.select(F.col("prefix").alias("_wanted")).distinct()
        counts = counts.join(wanted, F.substring("prefix", 1, width - step) == F.col("_wanted"), "left_semi")
    return counts.groupBy("prefix").agg(F.sum("n").alias("frequency")).withColumn("length", F.lit(width))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum of counts (prefix, frequency, length); nulls, empty prefixes and counts below 1 are left out."""
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    sound = total.where("prefix is not null and prefix <> '' and frequency > 0")
    return sound.groupBy("prefix", "length").agg(F.sum("frequency").alias("frequency")).select("prefix", "frequency", "length")


def partition_by_frequency(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(those of at most limit, those above)."""
    return counts.where(F.col("frequency") <= limit), counts.where(F.col("frequency") > limit)


def at_least(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("frequency") >= least)


def by_frequency(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties by prefix."""
    return counts.orderBy(F.desc("frequency"), "prefix")


def discover(
    corpus: DataFrame, limit: int, max_window: int = 100, window: int = 1, step: int = 1, exclude_newlines: bool = True, superstring: bool = False, complete: bool = False
) -> tuple[DataFrame, int]:
    """Prefixes (prefix, frequency, length) of at most limit suffixes each, none the beginning of another, and the last window's width.

    Each round widens the windows and counts only those that go on from a prefix still above limit, so the rounds get smaller.
    superstring adds the separators and the terminator as prefixes of their own. complete adds, for each prefix that was extended, the
    suffixes that end within the next window: prefix with a terminator behind it.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    accepted: list[DataFrame] = []
    targets, width = None, window
    while True:
        if width > max_window:
            raise ValueError(f"some prefix of {max_window} characters is still too frequent")
        counts = cut(window_counts(corpus, width, exclude_newlines, targets, step))
        below, above = partition_by_frequency(counts, limit)
        accepted.append(below)
        if above.isEmpty():
            break
        if complete:
            accepted.append(_tails(corpus, above, width, step, exclude_newlines))
        targets = above.select("prefix")
        width += step
    found = accepted[0]
    for more in accepted[1:]:
        found = found.unionByName(more)
    if superstring:
        n = corpus.count()
        rows = [(s, c, 1) for s, c in ((SEPARATOR, n - 1), (TERMINATOR, 1)) if c > 0]
        found = found.unionByName(corpus.sparkSession.createDataFrame(rows, "prefix string, frequency long, length int"))
    return found, width


def _tails(corpus: DataFrame, above: DataFrame, width: int, step: int, exclude_newlines: bool) -> DataFrame:
    ends = None
    for n in range(width, width + step):
        tail = corpus.where(F.length("text") >= n).select(F.expr(f"right(text, {n})").alias("tail"))
        ends = tail if ends is None else ends.unionByName(tail)
    if exclude_newlines:
        ends = ends.where(~F.col("tail").rlike(EXCLUDED))
    hit = ends.join(above.select(F.col("prefix").alias("_above")), F.substring("tail", 1, width) == F.col("_above"), "left_semi")
    return hit.groupBy(F.concat("tail", F.lit(TERMINATOR)).alias("prefix")).agg(F.count("*").alias("frequency")).withColumn("length", F.length("prefix"))


def uncovered(corpus: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(characters, covered, uncovered): suffixes of all texts, those that begin with one of the prefixes, and the rest."""
    total = corpus.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("characters"))
    covered = prefixes.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("covered"))
    return total.crossJoin(covered).withColumn("uncovered", F.col("characters") - F.col("covered"))


def prune(prefixes: DataFrame, max_length: int = 100) -> DataFrame:
    """The prefixes that don't begin with another, shorter one of them. Lengths are few, so each is an equi-join."""
    prefixes = cut(prefixes)
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    kept = prefixes
    for n in lengths[:-1]:
        short = prefixes.where(F.length("prefix") == n).select(F.col("prefix").alias("_short"))
        kept = kept.join(short, (F.length("prefix") > n) & (F.substring("prefix", 1, n) == F.col("_short")), "left_anti")
    return kept
