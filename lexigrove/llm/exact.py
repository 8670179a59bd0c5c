"""Exact deduplication with counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts into counting quotient filters, one
for each slice of the fingerprint space. A filter keeps, sorted, the quotient of a fingerprint by its place
and the remainder in full, so filters of one slice merge without loss. Only the documents whose
fingerprint is counted more than once send their text on, to be compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut
from .common import col, fresh, int_text

_U = np.uint64
#: Fingerprints of a slice, at most about so many: what a merging task holds doesn't grow with the table.
SLICE_ROWS = 1 << 20


@dataclass
class CountingQuotientFilter:
    """A multiset of fingerprints of `bits` bits each.

    occupied: bit q is set if some fingerprint has quotient q. Slots hold the remainders, sorted
    within the run of their quotient; ends marks the last slot of each run. repeated marks the slots
    counted more than once; counters has their counts, in the order of the slots.
    """

    bits: int
    quotient_bits: int
    occupied: np.ndarray
    ends: np.ndarray
    remainders: np.ndarray
    repeated: np.ndarray
    counters: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints and their counts."""
        n = len(values)
        q = min(bits, max(1, int(n / 0.9).bit_length()))
        quotient = values >> _U(bits - q)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        remainders = values & _U((1 << (bits - q)) - 1)
        return cls(bits, q, occupied, ends, remainders, counts > 1, counts[counts > 1].astype(np.uint32))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct fingerprints and their counts."""
        run = np.cumsum(self.ends) - self.ends
        quotient = np.flatnonzero(self.occupied)[run].astype(_U)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.repeated] = self.counters
        return (quotient << _U(self.bits - self.quotient_bits)) | self.remainders, counts

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        filters = list(filters)
        parts = [f.items() for f in filters]
        values, counts = merged(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))
        return cls.build(values, counts, filters[0].bits)

    def count(self, value: int) -> int:
        shift = self.bits - self.quotient_bits
        quotient, remainder = value >> shift, value & ((1 << shift) - 1)
        if not self.occupied[quotient]:
            return 0
        run = int(self.occupied[:quotient].sum())
        ends = np.flatnonzero(self.ends)
        a, b = (int(ends[run - 1]) + 1 if run else 0), int(ends[run]) + 1
        at = a + int(np.searchsorted(self.remainders[a:b], _U(remainder)))
        if at == b or int(self.remainders[at]) != remainder:
            return 0
        return int(self.counters[int(self.repeated[:at].sum())]) if self.repeated[at] else 1

    def to_bytes(self) -> bytes:
        width = (self.bits - self.quotient_bits + 7) // 8
        head = np.array([self.bits, self.quotient_bits, len(self.remainders), len(self.counters)], np.int64)
        tail = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        bitmaps = [np.packbits(x).tobytes() for x in (self.occupied, self.ends, self.repeated)]
        return head.tobytes() + b"".join(bitmaps) + self.counters.tobytes() + tail.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n, repeats = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at, maps = 32, []
        for size in (1 << q, n, n):
            step = (size + 7) // 8
            maps.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=size).astype(bool))
            at += step
        counters = np.frombuffer(data, np.uint32, repeats, at)
        at += 4 * repeats
        width = (bits - q + 7) // 8
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        return cls(bits, q, maps[0], maps[1], full.view("<u8").reshape(-1), maps[2], counters)


def merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with summed counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    return values[at], np.add.reduceat(counts, at)


def _build_filters(slice_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U) for b in batches if b.num_rows]
        if not parts:
            return
        values = np.concatenate(parts)
        values, counts = merged(values, np.ones(len(values), np.int64))
        bits = 64 - slice_bits
        which = (values >> _U(bits)).astype(np.int64) if slice_bits else np.zeros(len(values), np.int64)
        cuts = np.searchsorted(which, np.arange((1 << slice_bits) + 1))
        filled = np.flatnonzero(np.diff(cuts))
        mask = _U((1 << bits) - 1)
        data = [CountingQuotientFilter.build(values[cuts[i] : cuts[i + 1]] & mask, counts[cuts[i] : cuts[i + 1]], bits).to_bytes() for i in filled]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(data, pa.binary())], ["slice", "filter"])

    return build


def _merge_filters(table: pa.Table) -> pa.Table:
    merged_filter = CountingQuotientFilter.merge(CountingQuotientFilter.from_bytes(x) for x in table["filter"].to_pylist())
    values, counts = merged_filter.items()
    more = counts > 1
    full = (_U(table["slice"][0].as_py()) << _U(merged_filter.bits)) | values[more] if merged_filter.bits < 64 else values[more]
    return pa.table({"fp": pa.array(full.view(np.int64)), "n": pa.array(counts[more], pa.int64())})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints counted more than once, from a frame with the one long column fp and so many rows."""
    slice_bits = max(1, (int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (rows // SLICE_ROWS).bit_length())
    filters = fingerprints.mapInArrow(_build_filters(slice_bits), "slice long, filter binary")
    return filters.groupBy("slice").applyInArrow(_merge_filters, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row (doc_id, keep_id, copies, keep): the least id with the same text, how many rows have that text,
    and whether this row's id is that least one.

    A null text equals no other: it stands alone (copies 1). The empty text is a text like any other. Rows with
    a null id count as copies but are never the one kept, unless no id of their group is known (keep_id is null then, and
    keep true). Rows that repeat an id with its text all get the same answer. An empty table gives no rows.
    """
    lean = int_text(docs, id_col, text_col).withColumn("fp", F.xxhash64("text"))
    repeats = cut(repeated_fingerprints(lean.where("text is not null").select("fp"), lean.count()))
    routed = lean.where("text is not null").join(checked_broadcast(repeats.select("fp"), 24), "fp", "left_semi")
    texts = cut(routed.groupBy("fp", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")))
    variants = texts.groupBy("fp").agg(F.count("*").alias("variants"), F.first("keep_id").alias("keep_id"), F.first("copies").alias("copies"))
    variants = cut(variants)
    alone = variants.where("variants = 1 and copies > 1").select("fp", "keep_id", "copies")
    clashing = variants.where("variants > 1").select("fp")
    keys = lean.select("id", F.when(F.col("text").isNotNull(), F.col("fp")).alias("fp"))
    if clashing.count():  # different texts with one fingerprint: settled by the text itself
        clashing = checked_broadcast(clashing, 24)
        settled = lean.where("text is not null").join(clashing, "fp", "left_semi").join(texts, ["fp", "text"]).select("id", "keep_id", "copies")
        keys = keys.join(clashing, "fp", "left_anti")
    else:
        settled = None
    out = keys.join(checked_broadcast(alone, 40), "fp", "left").select("id", "keep_id", "copies")
    if settled is not None:
        out = out.unionByName(settled)
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    keep_id = F.when(copies > 1, F.col("keep_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), keep_id.alias("keep_id"), copies.alias("copies"), F.col("id").eqNullSafe(keep_id).alias("keep"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, one row of each text: the one with the least id (null ids last), among equal ids the one whose other columns come first as a JSON object.

    So the row kept doesn't depend on how docs is partitioned. Texts may be of any length. A null text equals no other, so its rows all stay. Other columns, whatever their names, go with their row.
    """
    fp, rank, row = fresh(docs, "fp", "fp_rank", "fp_row")
    text = col(docs, text_col)
    marked = docs.withColumn(fp, F.when(text.isNotNull(), F.xxhash64(text.cast("string"))))
    repeats = cut(repeated_fingerprints(marked.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp")), docs.count()))
    small = checked_broadcast(repeats.select(F.col("fp").alias(fp)), 24)
    single = marked.join(small, fp, "left_anti").select(*[col(docs, c) for c in docs.columns])
    routed = marked.join(small, fp, "left_semi")
    others = F.to_json(F.struct(F.lit(0).alias(fp), *[col(docs, c).alias(c) for c in docs.columns if c.lower() != text_col.lower()]))
    key = col(docs, id_col).cast("long")
    best = routed.withColumn(rank, F.struct(key.isNull(), key, others))
    held = F.struct(*[col(docs, c).alias(c) for c in docs.columns])
    kept = best.groupBy(fp, text).agg(F.min_by(held, F.col(rank)).alias(row)).select(f"{row}.*")
    return single.unionByName(kept)
