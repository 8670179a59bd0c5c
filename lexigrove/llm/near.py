"""Near-duplicate documents by MinHash samples folded into odd sketches.

Every text gives `samples` MinHash values (one permutation, empty bins densified). Bands of the values
find candidates; the values folded into a bitmap of parities (odd sketch) verify them: the
population count of the XOR of two sketches estimates their similarity, most precisely where that is high.
Linked documents form groups, found by alternating minimum-label steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import slices
from ..storage import checked_broadcast, cut
from . import words
from .common import binary_rows, col, fixed_matrix, fresh, int_text, list_array, whole_groups

_U = np.uint64
#: Members of a bucket that a task compares at once.
PIECE = 50_000
SAMPLES, SKETCH_BITS, BANDS, ROWS, SHINGLE, THRESHOLD = 256, 512, 42, 6, 2, 0.6

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_FOLD[65:91] += 32
_FILL = np.stack([np.random.default_rng([515, j]).permutation(SAMPLES) for j in range(SAMPLES)])
_BIN_SALT = np.random.default_rng(8813).integers(0, 1 << 63, SAMPLES, dtype=np.int64).view(_U)


def folded(raw: np.ndarray) -> np.ndarray:
    """The bytes with ASCII punctuation as spaces and upper-case letters (ASCII and Latin-1) as lower-case ones."""
    out = _FOLD[raw]
    if len(raw):
        upper = np.zeros(len(raw), bool)
        upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[upper] += 32
    return out


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of `size` folded words; a text with fewer words, but some, has one shingle."""
    raw, offsets = words.text_buffer(column)
    raw = folded(raw)
    start, end, first = words.word_spans(raw, offsets)
    code = words.hash_spans(raw, start, end)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = words.whole(first, size, len(code))
    grams, owner = words.gram_hashes(code, size)[ok], row[: len(ok)][ok]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    extra = np.array([words.gram_hashes(code[first[i] : first[i + 1]], int(n[i]))[0] for i in short], _U)
    return np.concatenate([owner, short]), np.concatenate([grams, extra])


def minhash(row: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their SAMPLES MinHash values each."""
    none = ~_U(0)
    table = np.full(n * SAMPLES, none, _U)
    h = words.mix(grams + _U(0x9E3779B97F4A7C15))
    place = row * SAMPLES + (h >> _U(56)).astype(np.int64)
    np.minimum.at(table, place, h & _U((1 << 56) - 1))
    table = table.reshape(n, SAMPLES)
    rows = np.flatnonzero((table != none).any(axis=1))
    table = table[rows]
    full = table.copy()
    r, c = np.nonzero(table == none)
    for step in range(SAMPLES):
        if not len(r):
            break
        got = table[r, _FILL[c, step]]
        hit = got != none
        full[r[hit], c[hit]] = got[hit]
        r, c = r[~hit], c[~hit]
    return rows, full


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """For each row of MinHash values the parities of how many fall on each of SKETCH_BITS bits, as bytes."""
    n = len(values)
    bit = (words.mix(values ^ _BIN_SALT) % _U(SKETCH_BITS)).astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    parity = np.bincount(bit.ravel(), minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, SKETCH_BITS), axis=1)


def band_hashes(values: np.ndarray) -> np.ndarray:
    mixed = words.mix(values[:, : BANDS * ROWS] ^ _BIN_SALT[: BANDS * ROWS]).reshape(len(values), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = words.mix(total * _U(0xD1342543DE82EF95) + mixed[:, :, k])
    return total


def similarity(differing: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the population count of the XOR of two odd sketches."""
    odd = np.minimum(1 - 2 * differing / SKETCH_BITS, 1.0)
    return np.where(odd > 0, 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(odd, 1e-12)), 0.0)


def most_differing(threshold: float) -> int:
    """The largest population count of which the similarity is still at least threshold."""
    return int(np.flatnonzero(similarity(np.arange(SKETCH_BITS + 1)) >= threshold).max())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            rows, values = minhash(*shingles(part.column(1)), part.num_rows)
            bands = band_hashes(values)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), binary_rows(odd_sketches(values)), list_array(bands.view(np.int64).ravel(), np.full(len(rows), BANDS), pa.int64())],
                ["id", "sketch", "bands"],
            )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sketch, bands) of every row that has an id and at least one word."""
    return int_text(docs, id_col, text_col).where("id is not null and text is not null").mapInArrow(_sketch, "id long, sketch binary, bands array<long>")


def linked(ids: np.ndarray, bitmaps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id of its component) within one bucket: components of the pairs whose sketches differ in at most `most` bits.

    Each step compares one member of a component with all that no component has yet, so a bucket of copies costs one pass.
    """
    order = np.argsort(ids, kind="stable")
    ids, bitmaps = ids[order], bitmaps[order]
    label = np.full(len(ids), -1)
    open_ = np.arange(len(ids))
    while len(open_):
        seed = int(open_[0])
        label[seed] = seed
        open_ = open_[1:]
        frontier = [seed]
        while frontier and len(open_):
            differ = np.bitwise_count(bitmaps[open_] ^ bitmaps[frontier.pop()]).sum(axis=1)
            near = open_[differ <= most]
            label[near] = seed
            frontier.extend(near.tolist())
            open_ = open_[differ > most]
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _verify(most: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by meeting, which is a bucket or two pieces of a large one."""
        for table in whole_groups(batches, "meeting"):
            bucket, ids = table["meeting"].to_numpy(), table["id"].to_numpy()
            bitmaps = fixed_matrix(table["sketch"], _U, SKETCH_BITS // 64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            found = [linked(ids[a:b], bitmaps[a:b], most) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
            pairs = np.unique(np.stack([np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    return verify


def near_edges(sketched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct verified edges (a, b), b < a, that connect the near-duplicates among sketched rows (id, sketch, bands).

    Rows with one sketch and the same bands are alike for every comparison: they hang on the least id of theirs, which alone goes through the buckets.
    """
    same = sketched.withColumn("all", F.xxhash64("bands", "sketch"))
    alike = cut(same.groupBy("all").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").select("all", "b"))
    small = checked_broadcast(alike, 32)
    copies = same.join(small, "all").where("id <> b").select(F.col("id").alias("a"), "b")
    single = cut(same.join(small, "all", "left").where("b is null or id = b").select("id", "sketch", "bands"))
    in_bands = single.select("id", F.explode("bands").alias("bucket"))
    # counted where the bucket's members meet, so that the rows of all bands, most of them alone in their buckets, are moved once
    counted = in_bands.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    # the members of a bucket that is larger than a task should hold are cut into pieces, and each two pieces meet
    members = counted.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    others = F.when(F.col("pieces") > 1, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.lit(0)))
    met = members.select("id", "bucket", "piece", "pieces", F.explode(others).alias("other"))
    low, high = F.least("piece", "other"), F.greatest("piece", "other")
    meeting = F.when(F.col("pieces") > 1, F.xxhash64("bucket", low, high)).otherwise(F.col("bucket"))
    placed = met.select("id", meeting.alias("meeting")).join(single.select("id", "sketch"), "id")
    ordered = placed.repartition("meeting").sortWithinPartitions("meeting")
    verified = ordered.select("meeting", "id", "sketch").mapInArrow(_verify(most_differing(threshold)), "a long, b long")
    return copies.unionByName(verified).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id), for every id on an edge (a, b) the least id it is connected with.

    Alternates the large-star and small-star steps until no edge changes; each round's edges are written to the shared folder.
    """
    edges = cut(edges.select("a", "b"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("group_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each row (doc_id, group_id, keep): the least id of its group of near-duplicates, and whether the row has it.

    Texts are compared by their pairs of successive words, without case and ASCII punctuation. Rows that are linked, directly or through others, by an
    estimated Jaccard similarity of at least threshold form a group. A pair of similarity s meets in a band with the probability 1 - (1 - s**ROWS)**BANDS, which is
    0.87 at 0.6, 0.99 at 0.69 and 0.9997 at 0.75. Texts may be of any length. A null text, or one without a word, is alone; so is a row with a null id
    (its group_id is null, keep true). Rows that repeat an id get that id's answer. An empty table gives no rows.
    """
    groups = components(near_edges(cut(sketches(docs, id_col, text_col)), threshold))
    keys = docs.select(col(docs, id_col).cast("long").alias("id"))
    groups = checked_broadcast(cut(groups), 32)
    group_id = F.coalesce("group_id", "id")
    return keys.join(groups, "id", "left").select(F.col("id").alias("doc_id"), group_id.alias("group_id"), F.col("id").eqNullSafe(group_id).alias("keep"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that near_groups doesn't keep. Rows with the same id are one document and stay or go together."""
    group, key = fresh(docs, "near_group", "near_key")
    groups = cut(components(near_edges(cut(sketches(docs, id_col, text_col)), threshold)).where("id <> group_id"))
    dropped = checked_broadcast(groups.select(F.col("id").alias(group)), 24)
    marked = docs.withColumn(key, col(docs, id_col).cast("long"))
    return marked.join(dropped, marked[key] == dropped[group], "left_anti").select(*[col(docs, c) for c in docs.columns])
