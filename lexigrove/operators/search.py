"""Where a position lies, and where a pattern occurs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..storage import cut
from .prefixes import windows

#: Patterns of a list that are looked for in each text.
FEW = 32


def position_to_document(positions: DataFrame, bounds: DataFrame, bucket: int | None = None) -> DataFrame:
    """(pos, index, name, local) of each position: the document whose [start, end) holds it; behind the last end, the last document, with its length; else nulls.

    A range join as an equi-join: positions and documents meet in buckets of the coordinate.
    """
    bounds = cut(bounds)
    stats = bounds.agg(F.max("end").alias("end"), F.avg(F.col("end") - F.col("start")).alias("size")).first()
    if stats.end is None:
        return positions.select("pos", F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("local"))
    size = bucket or max(1, int(stats.size or 1) * 4)
    spread = bounds.where("end > start").select("index", "name", "start", "end", F.explode(F.sequence((F.col("start") / size).cast("long"), ((F.col("end") - 1) / size).cast("long"))).alias("bucket"))
    last = bounds.orderBy(F.desc("end"), F.desc("index")).first()
    placed = positions.withColumn("bucket", F.floor(F.col("pos") / size))
    hit = placed.join(spread, "bucket", "left").where("index is null or (pos >= start and pos < end)")
    hit = placed.select("pos").join(hit.where("index is not null").select("pos", "index", "name", (F.col("pos") - F.col("start")).alias("local")).distinct(), "pos", "left")
    behind = F.col("index").isNull() & (F.col("pos") >= last.end)
    return hit.select(
        "pos",
        F.when(behind, F.lit(last["index"])).otherwise(F.col("index")).cast("int").alias("index"),
        F.when(behind, F.lit(last.name)).otherwise(F.col("name")).alias("name"),
        F.when(behind, F.lit(last.end - last.start)).otherwise(F.col("local")).cast("long").alias("local"),
    )


def occurrences(corpus: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """(pattern, doc_id, pos) of all occurrences, overlapping ones too; an empty or null pattern has none.

    A list of a few patterns is looked for text by text, all in one pass. Of more patterns, those of one length are one hash join with the windows of that length.
    """
    spark = corpus.sparkSession
    if isinstance(patterns, list) and len(patterns) <= FEW:
        return corpus.select("doc_id", "text").mapInArrow(_find(sorted({p for p in patterns if p})), "pattern string, doc_id long, pos long")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string") if isinstance(patterns, list) else patterns.select("pattern")
    table = cut(table.where("pattern is not null and pattern <> ''").distinct())
    found = None
    for n in sorted(r[0] for r in table.select(F.length("pattern")).distinct().collect()):
        hit = windows(corpus, n, exclude_newlines=False).join(table.where(F.length("pattern") == n), F.col("prefix") == F.col("pattern")).select("pattern", "doc_id", "pos")
        found = hit if found is None else found.unionByName(hit)
    return found if found is not None else spark.createDataFrame([], "pattern string, doc_id long, pos long")


def _find(patterns: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            which, row, pos = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for number, pattern in enumerate(patterns):
                    at = text.find(pattern) if text else -1
                    while at >= 0:
                        which.append(number)
                        row.append(k)
                        pos.append(at)
                        at = text.find(pattern, at + 1)
            names = pa.array(patterns, pa.string()).take(pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_arrays([names, batch.column(0).take(pa.array(row, pa.int32())), pa.array(pos, pa.int64())], ["pattern", "doc_id", "pos"])

    return find


def occurrence_counts(corpus: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    return occurrences(corpus, patterns).groupBy("pattern").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("documents"))


def contains(corpus: DataFrame, pattern: str) -> DataFrame:
    """The texts that have the pattern."""
    return corpus.where(F.contains("text", F.lit(pattern)))
