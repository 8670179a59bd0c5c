"""Suffixes of each prefix in order, with their longest common prefixes, and the sub-trees over them.

A corpus of at most BLOCK_CHARS characters is a block, which each task can hold: the tasks share out the prefixes. Beyond that, tasks share out ranges of
suffixes and map the characters from a file (see mapped). Where the shared folder can't be mapped, or texts have ends that count as characters, global
ranks come by prefix doubling, in which nothing longer than a few characters is ever moved. All give the same rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import RANGE, first_record, record
from ..functions.symbols import SEPARATOR, TERMINATOR, sort_key
from ..storage import checked_broadcast, cut, cut_path, drop, new_folder, shared_folder
from . import mapped, tree
from .block import Block, buckets, suffix_order
from .prefixes import windows

#: Characters of a block. A worker holds some 20 bytes for each, and TASK_SUFFIXES suffixes at 150 bytes.
BLOCK_CHARS, TASK_SUFFIXES = 32_000_000, 1_500_000
#: Characters of a block of which only the suffix array is wanted: a task there holds all of a prefix, however frequent.
ARRAY_CHARS = 1_000_000
#: Characters of the first ranks.
FIRST = 8


def bucketed(corpus: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, doc_id, pos): the suffixes that begin with each prefix. Each length is an equi-join with the windows of that length."""
    prefixes = cut(prefixes.select(F.col("prefix").alias("bucket")))
    found = None
    for n in sorted(r[0] for r in prefixes.select(F.length("bucket")).distinct().collect()):
        mine = checked_broadcast(prefixes.where(F.length("bucket") == n), 64)
        hit = windows(corpus, n, exclude_newlines=False).join(mine, F.col("prefix") == F.col("bucket"), "left_semi")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return corpus.sparkSession.createDataFrame([], "prefix string, doc_id long, pos long")
    return found.select("prefix", "doc_id", "pos")


def _dense(df: DataFrame, key: Column) -> DataFrame:
    """df with rank: how many rows have a smaller key. Range-partitioned; one total per partition meets on the driver."""
    placed = cut(df.withColumn("_key", key).repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    totals, before, table = placed.groupBy("_part").count().orderBy("_part").collect(), 0, []
    for row in totals:
        table.append((row._part, before))
        before += row["count"]
    offsets = df.sparkSession.createDataFrame(table, "_part int, _before long")
    inside = F.rank().over(Window.partitionBy("_part").orderBy("_key")) - 1
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("_before") + inside).cast("long")).drop("_key", "_part", "_before")


def doubled_ranks(corpus: DataFrame, joined: bool = False) -> list[tuple[int, DataFrame]]:
    """Rounds (h, (doc_id, pos, rank)): ranks of all suffixes by their first h characters, equal ones equal; in the last round only equal suffixes are.

    A round pairs each rank that others share with the rank h places on (none: the text ends there) and ranks the pairs within the shared rank.
    """
    heads = windows(corpus, FIRST, exclude_newlines=False, short=True).select("doc_id", "pos", "prefix")
    ranks = cut(_dense(heads, sort_key(F.col("prefix")) if joined else F.col("prefix")).select("doc_id", "pos", "rank"))
    longest = corpus.agg(F.max(F.length("text"))).first()[0] or 0
    rounds, h = [(FIRST, ranks)], FIRST
    while h < longest:
        shared = ranks.groupBy("rank").count().where("count > 1").select("rank")
        alive = ranks.join(shared, "rank", "left_semi")
        ahead = ranks.select("doc_id", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
        pairs = alive.join(ahead, ["doc_id", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long")))
        finer = pairs.withColumn("new", F.col("rank") + F.rank().over(Window.partitionBy("rank").orderBy("next")) - 1)
        changed = cut(finer.select("doc_id", "pos", "new", (F.col("new") != F.col("rank")).alias("moved")))
        if changed.where("moved").isEmpty():
            break
        ranks = cut(ranks.join(changed.select("doc_id", "pos", "new"), ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("new", "rank").alias("rank")))
        h *= 2
        rounds.append((h, ranks))
    return rounds


def _doubled(corpus: DataFrame, prefixes: DataFrame, joined: bool) -> DataFrame:
    rounds = doubled_ranks(corpus, joined)
    placed = bucketed(corpus, prefixes).join(rounds[-1][1], ["doc_id", "pos"])
    order = Window.partitionBy("prefix").orderBy("rank", "doc_id", "pos")
    pairs = placed.select("prefix", "doc_id", "pos", (F.row_number().over(order) - 1).cast("long").alias("at"), F.lag("doc_id").over(order).alias("d2"), F.lag("pos").over(order).alias("p2"))
    pairs = cut(pairs.withColumn("lcp", F.lit(0).cast("long")))
    # equal ranks of the first h characters: skip h characters of both; then fewer, down to FIRST
    for h, ranks in reversed(rounds):
        a = ranks.select(F.col("doc_id"), F.col("pos").alias("_p"), F.col("rank").alias("_a"))
        b = ranks.select(F.col("doc_id").alias("d2"), F.col("pos").alias("_q"), F.col("rank").alias("_b"))
        both = pairs.withColumn("_p", F.col("pos") + F.col("lcp")).withColumn("_q", F.col("p2") + F.col("lcp"))
        both = both.join(a, ["doc_id", "_p"], "left").join(b, ["d2", "_q"], "left")
        pairs = cut(both.withColumn("lcp", F.when(F.col("_a") == F.col("_b"), F.col("lcp") + h).otherwise(F.col("lcp"))).select("prefix", "doc_id", "pos", "at", "d2", "p2", "lcp"))
    size = corpus.select("doc_id", F.length("text").alias("size"), "text")
    tail = lambda text, at: F.substring(text, at.cast("int") + 1, F.lit(FIRST))
    ends = pairs.join(size, "doc_id", "left").withColumn("x", tail(F.col("text"), F.col("pos") + F.col("lcp"))).drop("text")
    other = size.select(F.col("doc_id").alias("d2"), F.col("text").alias("t2"), F.col("size").alias("s2"))
    ends = ends.join(other, "d2", "left").withColumn("y", tail(F.col("t2"), F.col("p2") + F.col("lcp"))).drop("t2")
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(FIRST)), F.lit(0), lambda n, k: F.when((F.length("x") >= k) & (F.substring("x", F.lit(1), k) == F.substring("y", F.lit(1), k)) & (F.length("y") >= k), k).otherwise(n))
    within = F.least(F.col("lcp") + rest, F.col("size") - F.col("pos"), F.col("s2") - F.col("p2"))
    return ends.select("prefix", F.col("at").alias("rank"), "doc_id", "pos", F.coalesce(within, F.lit(0)).cast("int").alias("lcp"))


@lru_cache(maxsize=1)
def _block(path: str, special: str) -> Block:
    """The texts of a written table, by doc_id (null first)."""
    system, root = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    rows = pa.concat_tables(pyarrow.parquet.read_table(f, filesystem=system, columns=["doc_id", "text"]) for f in files)
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
    return Block.of(rows["doc_id"].combine_chunks(), rows["text"].to_pylist(), special)


@lru_cache(maxsize=1)
def _places(path: str, special: str, prefixes: tuple[str, ...], terminator: str | None) -> np.ndarray:
    return buckets(_block(path, special), list(prefixes), terminator)


def _build(path: str, special: str, prefixes: list[str], task_of: np.ndarray, terminator: str | None, end: int, max_positions: int | None, folder: str):
    names = tuple(prefixes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for task in (x for batch in batches for x in batch.column(0).to_pylist()):
            block, found = _block(path, special), _places(path, special, names, terminator)
            at = np.flatnonzero(np.append(task_of == task, False)[found])
            if max_positions is not None:
                by = np.argsort(found[at], kind="stable")
                number = found[at[by]]
                at = at[by[np.arange(len(by)) - np.searchsorted(number, number) < max_positions]]
            place, lcp = suffix_order(block, at)
            number = found[place]
            begins = np.ones(len(place), bool)
            begins[1:] = number[1:] != number[:-1]
            lcp[begins] = 0
            doc = block.doc(place)
            ids = block.ids.take(pa.array(doc))
            valid = None if not ids.null_count else ids.is_valid().to_numpy(zero_copy_only=False)
            room = block.end[doc] - place
            prefix = pa.DictionaryArray.from_arrays(pa.array(number), pa.array(names, pa.string()))
            out = tree.table(prefix, lcp, room, place - block.begin[doc], ids.fill_null(0).to_numpy(zero_copy_only=False), valid, begins, end)
            # a name of its own for each attempt: only that of the one that counts comes back
            name = f"{uuid.uuid4().hex}.parquet"
            pyarrow.parquet.write_table(out, f"{root}/{name}", filesystem=system, store_schema=False)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return build


def _shared_out(frequencies: list[int], tasks: int) -> np.ndarray:
    """A task for each prefix, the most frequent first to the least loaded."""
    heap = [(0, t) for t in range(tasks)]
    out = np.zeros(len(frequencies), np.int64)
    for i in np.argsort(-np.array(frequencies, np.int64), kind="stable").tolist():
        load, t = heap[0]
        out[i] = t
        heapq.heapreplace(heap, (load + frequencies[i], t))
    return out


def _in_block(corpus: DataFrame, prefixes: DataFrame, boundary: str, special: str, terminator: str | None, max_positions: int | None, folder: str | None = None) -> DataFrame:
    """tree.elements of a block, each task's written by itself: rows of texts' places never pass through the JVM."""
    folder = folder or new_folder(corpus.sparkSession)
    spark = corpus.sparkSession
    _, path = cut_path(corpus.select("doc_id", "text"))
    # a block's prefixes are bounded as the block is; without a frequency they count alike
    counted = prefixes if "frequency" in prefixes.columns else prefixes.withColumn("frequency", F.lit(1))
    rows = [(r.prefix, r.frequency) for r in counted.select("prefix", "frequency").collect() if r.prefix]
    total = sum(f for _, f in rows)
    tasks = max(1, min(len(rows), max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_SUFFIXES))))
    task_of = _shared_out([f for _, f in rows], tasks)
    build = _build(path, special, [p for p, _ in rows], task_of, terminator, 1 if boundary == "document" else 0, max_positions, folder)
    names = [r.name for r in spark.range(tasks, numPartitions=tasks).mapInArrow(build, "name string").collect()]  # one a task
    drop(spark, path)
    return spark.read.schema(tree.ELEMENTS).parquet(*(f"{folder}/{n}" for n in names))


def _few_characters(corpus: DataFrame, most: int | None = None) -> bool:
    return (corpus.agg(F.sum(F.length("text").cast("long") + 1)).first()[0] or 0) <= (BLOCK_CHARS if most is None else most)


def _beyond_a_block(corpus: DataFrame, prefixes: DataFrame, joined: bool, max_positions: int | None) -> DataFrame:
    if joined or max_positions is not None or not shared_folder(corpus.sparkSession).startswith("file://"):
        return _sorted(corpus, prefixes, joined, max_positions)
    return mapped.suffix_array(corpus, prefixes)


def tree_stats(corpus: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, leaves, max_depth) of the sub-trees over the suffixes of each prefix, none of which is written for a corpus beyond a block."""
    if _few_characters(corpus) or not shared_folder(corpus.sparkSession).startswith("file://"):
        return tree.tree_stats(index_elements(corpus, prefixes)).select("prefix", "leaves", "max_depth")
    return mapped.tree_stats(corpus, prefixes)


def index_elements(corpus: DataFrame, prefixes: DataFrame, boundary: str = "document", complete: bool = False, max_positions: int | None = None, strategy: str = "auto", folder: str | None = None) -> DataFrame:
    """The suffixes of each prefix in order and the sub-trees over them, in one table, written into folder if given; see tree.elements.

    boundary superstring: corpus is one text with separators and a terminator. complete: a prefix may end in the terminator, which stands for a text's end.
    """
    joined = boundary == "superstring"
    if strategy == "block" or (strategy == "auto" and _few_characters(corpus)):
        return _in_block(corpus, prefixes, boundary, TERMINATOR + SEPARATOR if joined else "", TERMINATOR if complete and not joined else None, max_positions, folder)
    if complete and not joined:
        ended = corpus.withColumn("text", F.concat("text", F.lit(TERMINATOR)))
        array = _without_terminators(_sorted(ended, prefixes, True, max_positions), corpus)
    else:
        array = _sorted(corpus, prefixes, joined, max_positions) if strategy == "doubling" else _beyond_a_block(corpus, prefixes, joined, max_positions)
    return cut_path(tree.elements(array, corpus, boundary), folder)[0]


def _without_terminators(array: DataFrame, corpus: DataFrame) -> DataFrame:
    """Common prefixes of texts with a terminator behind, as of the texts without: equal suffixes had the terminator in common too."""
    size = corpus.select("doc_id", F.length("text").alias("_n"))
    cutoff = array.join(size, "doc_id").withColumn("lcp", F.least(F.col("lcp"), (F.col("_n") - F.col("pos")).cast("int")))
    return cutoff.drop("_n").select("prefix", "rank", "doc_id", "pos", "lcp")


def suffix_array(corpus: DataFrame, prefixes: DataFrame, strategy: str = "auto", max_positions: int | None = None, joined: bool = False) -> DataFrame:
    """(prefix, rank, doc_id, pos, lcp): for each prefix its suffixes in order, equal ones by doc_id and pos; lcp with the one before, 0 for the first.

    A text's end comes before any character. joined: in the texts the terminator comes first, then the separator, then all else. strategy: block, mapped, doubling, or
    auto, which takes the first for a corpus of at most ARRAY_CHARS characters and else the second where it can; the rows are the same.
    max_positions keeps of each prefix only the first suffixes by doc_id and pos.
    """
    if strategy == "block" or (strategy == "auto" and _few_characters(corpus, min(ARRAY_CHARS, BLOCK_CHARS))):
        return tree.suffixes(_in_block(corpus, prefixes, "document", TERMINATOR + SEPARATOR if joined else "", None, max_positions))
    return _sorted(corpus, prefixes, joined, max_positions) if strategy == "doubling" else _beyond_a_block(corpus, prefixes, joined, max_positions)


def _sorted(corpus: DataFrame, prefixes: DataFrame, joined: bool, max_positions: int | None) -> DataFrame:
    found = _doubled(corpus, prefixes, joined)
    if max_positions is None:
        return found
    first = F.row_number().over(Window.partitionBy("prefix").orderBy("doc_id", "pos"))
    kept = found.withColumn("_first", first).where(F.col("_first") <= max_positions)
    # between kept neighbours lies the least lcp of those left out
    mark = kept.select("prefix", "rank", F.lit(True).alias("_kept"))
    order = Window.partitionBy("prefix").orderBy("rank")
    run = found.join(mark, ["prefix", "rank"], "left").withColumn("_run", F.count("_kept").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    least = run.withColumn("lcp", F.min("lcp").over(Window.partitionBy("prefix", "_run"))).where("_kept")
    again = F.row_number().over(order) - 1
    return least.select("prefix", again.cast("long").alias("rank"), "doc_id", "pos", F.when(again == 0, 0).otherwise(F.col("lcp")).alias("lcp"))


def lcp_ranges(array: DataFrame, corpus: DataFrame, size: int = RANGE) -> DataFrame:
    """(prefix, rank, doc_id, pos, char, range, offset): the record of each suffix of an array against the one before it in its prefix; see functions.ranges."""
    order = Window.partitionBy("prefix").orderBy("rank")
    pairs = array.select("prefix", "rank", "doc_id", "pos", "lcp", F.lag("doc_id").over(order).alias("d2"), F.lag("pos").over(order).alias("p2"))
    text, other = corpus.select("doc_id", "text"), corpus.select(F.col("doc_id").alias("d2"), F.col("text").alias("t2"))
    # only what the records show is cut out of the texts, so no suffix is written out
    cut_out = lambda t, p: F.substring(t, (p + F.col("lcp") + 1).cast("int"), F.lit(size))
    both = pairs.join(text, "doc_id").withColumn("own", cut_out(F.col("text"), F.col("pos"))).drop("text")
    both = both.join(other, "d2", "left").withColumn("theirs", cut_out(F.col("t2"), F.col("p2"))).drop("t2")
    found = F.when(F.col("d2").isNull(), first_record(F.col("own"), size)).otherwise(record(F.col("own"), F.col("theirs"), F.lit(0), size))
    shown = both.withColumn("r", found)
    return shown.select("prefix", "rank", "doc_id", "pos", "r.char", F.col("r.range").alias("range"), F.when(F.col("d2").isNull(), 0).otherwise(F.col("lcp")).alias("offset"))
