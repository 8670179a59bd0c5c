"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces of at most `capacity` words (with one end mark each). Pieces are spread by hash over
groups of a fixed expected load. A group is one differencing problem: every piece starts as a partial partition into k windows of which one is
filled; the two partial partitions with the largest spread merge, the fullest window of one with the emptiest of the other, until one partition is left.
If a window is over capacity, k rises and the group is solved again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..storage import checked_broadcast, cut
from . import words
from .common import int_text, ranges

CAPACITY = 2048
#: Windows that a group fills, on average. A larger group leaves less over and takes longer.
GROUP_WINDOWS = 48


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """For each of sizes its window, of k, by multiway differencing. Ties go by the order of sizes."""
    n = len(sizes)
    where = np.zeros(n, np.int64)
    if n == 0 or k == 1:
        return where
    # A node of the forest is a window of a partial partition: a leaf is a piece, an inner node joins two windows.
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    made = n
    # Only the filled windows of a partition are kept, fullest first; the others are empty.
    loads = {i: ([int(sizes[i])], [i]) for i in range(n)}
    heap = [(-int(sizes[i]), i) for i in range(n)]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        a, an = loads.pop(x)
        b, bn = loads.pop(y)
        over = len(a) + len(b) - k
        if over > 0:  # a's j-th fullest window meets b's j-th emptiest, the empty ones counted
            keep = len(a) - over
            out, nodes = a[:keep], an[:keep]
            for i, m in zip(range(keep, len(a)), range(len(b) - 1, -1, -1), strict=False):
                left[made], right[made] = an[i], bn[m]
                out.append(a[i] + b[m])
                nodes.append(made)
                made += 1
            low = k - len(a)
            out += b[:low]
            nodes += bn[:low]
        else:
            out, nodes = a + b, an + bn
        order = sorted(range(len(out)), key=lambda i: -out[i])
        out, nodes = [out[i] for i in order], [nodes[i] for i in order]
        spread = out[0] - (out[-1] if len(out) == k else 0)
        loads[fresh] = (out, nodes)
        heapq.heappush(heap, (-spread, fresh))
        fresh += 1
    _, nodes = loads.pop(heap[0][1])
    for window, node in enumerate(nodes):
        stack = [node]
        while stack:
            x = stack.pop()
            if left[x] >= 0:
                stack += [int(left[x]), int(right[x])]
            else:
                where[x] = window
    return where


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for sizes of at most capacity each; their number starts at the least that could do and rises while one is over capacity."""
    whole = sizes == capacity  # fills a window by itself
    where = np.zeros(len(sizes), np.int64)
    rest = np.flatnonzero(~whole)
    k = 0
    if len(rest):
        part = sizes[rest]
        k = max(-(-int(part.sum()) // capacity), int((2 * part > capacity).sum()), 1)
        while True:
            got = differencing(part, k)
            load = np.bincount(got, weights=part, minlength=k)
            over = np.maximum(load - capacity, 0).sum()
            if over == 0:
                break
            k += max(1, int(over // capacity))
        where[rest] = got
    where[whole] = k + np.arange(int(whole.sum()))
    return where


def word_counts(column: pa.Array) -> np.ndarray:
    raw, offsets = words.text_buffer(column)
    return np.diff(words.word_spans(raw, offsets)[2])


def _pieces(capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n = word_counts(batch.column(1))
            room = capacity - 1  # and the end mark
            count = -(-n // room)
            row = np.repeat(np.arange(len(n)), count)
            piece = ranges(np.zeros(len(n), np.int64), count)
            start = piece * room
            end = np.minimum(start + room, n[row])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "start_word", "end_word"])

    return pieces


def _solve(capacity: int):
    def solve(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].combine_chunks().fill_null(-(1 << 63)).to_numpy()
        start, end = table["start_word"].to_numpy(), table["end_word"].to_numpy()
        size = (end - start + 1).astype(np.int64)
        order = np.lexsort((start, ids, -size))
        where = pack_group(size[order], capacity)
        load = np.bincount(where, weights=size[order]).astype(np.int64)
        slot_order = np.lexsort((np.arange(len(where)), where))
        slot = np.empty(len(where), np.int64)
        first = np.searchsorted(where[slot_order], where[slot_order])
        slot[slot_order] = np.arange(len(where)) - first
        table = table.take(pa.array(order))
        window = (np.int64(table["bin"][0].as_py()) << np.int64(24)) + where
        return pa.table(
            {"window_id": pa.array(window), "slot": pa.array(slot.astype(np.int32)), "doc_id": table["doc_id"], "start_word": table["start_word"], "end_word": table["end_word"], "window_load": pa.array(load[where])}
        )

    return solve


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Windows of at most capacity words and end marks: (window_id, slot, doc_id, start_word, end_word, window_load).

    Every word (run of anything but ASCII white space) of every text is in exactly one row's [start_word, end_word); each row takes one place more for
    its end mark; window_load is the sum over the window. Null and empty texts have no rows. Rows with a null id or with an id that others
    have, however many, are packed like any other, and so are texts of any length. Ties in size go by id, then by place. Needs a capacity of at least 2. An empty table gives no rows.
    """
    if capacity < 2:
        raise ValueError("a window needs room for a word and an end mark")
    pieces = cut(int_text(docs, id_col, text_col).mapInArrow(_pieces(capacity), "doc_id long, start_word int, end_word int"))
    total = pieces.agg(F.sum(F.col("end_word") - F.col("start_word") + 1).cast("long")).first()[0] or 0
    bins = max(1, round(total / capacity / GROUP_WINDOWS))
    spread = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start_word"), F.lit(bins)))
    # rows without an id, or with one that many have, meet in one group: it is split by the place in the written table
    room = 4 * GROUP_WINDOWS * capacity
    load = spread.groupBy("bin").agg(F.sum(F.col("end_word") - F.col("start_word") + 1).alias("load"))
    hot = cut(load.where(F.col("load") > room).select("bin", F.ceil(F.col("load") / (GROUP_WINDOWS * capacity)).alias("parts")))
    more = hot.agg(F.max("parts")).first()[0] or 0
    if more:
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
        spread = spread.join(checked_broadcast(hot, 32), "bin", "left").withColumn("bin", F.col("bin") + part * bins).drop("parts")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # few bytes, much work: as many tasks as asked for, which adaptive execution would merge
    spread = spread.repartition(min(max(bins, more), max(4 * cores, bins // 8)), "bin")
    schema = "window_id long, slot int, doc_id long, start_word int, end_word int, window_load long"
    return spread.groupBy("bin").applyInArrow(_solve(capacity), schema)
