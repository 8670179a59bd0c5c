"""Suffixes of a corpus too large for a block, sorted in ranges: a task holds one range of suffixes, whatever the size of the corpus or of a prefix.

Characters are written once, a code each, into one file of the shared folder, which workers map into memory; mapped pages aren't theirs. A range is cut out of
the order of suffixes by splitters that a sample gives. Its suffixes are sorted by packed characters. Those that stay equal are told apart by anchors: places whose
hash is the least of WINDOW ones from there on, so that what lies ahead alone makes an anchor. Suffixes that agree beyond the next anchor agree on its
distance, and the anchor's rank decides. Anchors are one in WINDOW places; the text from one to the next is a symbol, and ranks are those of sequences of symbols.
"""

from __future__ import annotations

import bisect
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import slices
from ..storage import cut_path, drop, new_folder, shuffles_dropped
from . import tree
from .block import _BASE, _SALT, Block, _groups, _spread, buckets, suffix_order

_U = np.uint64
#: Suffixes of a range, at some 150 bytes; places that a task deals out at once; places for each anchor, and characters of an anchor's hash (in bytes of codes).
RANGE_SUFFIXES, CHUNK, WINDOW = 500_000, 2_000_000, 32
#: Anchors of a range, at some 150 bytes; groups in which ranges are dealt out at least, and suffixes of a group at most.
ANCHORS, GROUPS, GROUP_SUFFIXES = 300_000, 128, 20_000_000
#: Bytes behind the codes, so that a word can be read anywhere.
_PAD = 16


@dataclass(frozen=True)
class Mapped:
    """What tasks need to know of the files: folder, places (each text's end is one), texts, how many of the first have a null id, characters in order, window, whether anchors have ranks."""

    uri: str
    places: int
    docs: int
    nulls: int
    kinds: tuple[int, ...]
    window: int
    ranked: bool = False

    @property
    def folder(self) -> str:
        return self.uri.removeprefix("file://")

    @property
    def width(self) -> int:
        return 1 if len(self.kinds) < 1 << 8 else 2 if len(self.kinds) < 1 << 16 else 4


class View:
    """The mapped files of a corpus."""

    def __init__(self, m: Mapped) -> None:
        self.m, self.width, self.per = m, m.width, 8 // m.width
        path = lambda name: f"{m.folder}/{name}"
        read = lambda name, kind: np.memmap(path(name), kind, "r") if os.path.getsize(path(name)) else np.zeros(0, kind)
        self.raw = np.memmap(path("codes"), np.uint8, "r")
        self.code = self.raw[: m.places * self.width].view(f">u{self.width}")
        # a word of codes at any place, the first the highest
        self.words = np.ndarray((m.places + 1,), ">u8", self.raw, 0, (self.width,))
        self.end, self.ids, self.anchors = read("ends", np.int64), read("ids", np.int64), read("anchors", np.int64)
        self.rank = None
        if m.ranked and len(self.anchors):
            self.rank, self.least = read("rank", np.int32), Minima.read(m.folder)
        bits = 8 * self.width
        self.masks = np.array([(1 << 64) - (1 << (64 - bits * r)) for r in range(self.per + 1)], object).astype(_U)
        self.bits = bits

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at)

    def key(self, at: np.ndarray, limit: np.ndarray, offset: int) -> np.ndarray:
        """A word of the codes from there on, those from limit on as 0."""
        p = np.minimum(at + offset, limit)
        return self.words[p].astype(_U) & self.masks[np.minimum(limit - p, self.per)]

    def lead(self, x: np.ndarray, chars: int) -> np.ndarray:
        """Codes that agree before the first difference, x being the difference of words of so many codes."""
        out = np.zeros(len(x), np.int64)
        for j in range(1, chars + 1):
            out += x < _U(1 << (self.bits * (chars - j))) if j < chars else x == 0
        return out


class Minima:
    """Least values of ranges of an array: by blocks of SIZE, and a table of runs of blocks of each power of two."""

    SIZE = 32

    def __init__(self, values: np.ndarray, ahead: np.ndarray, back: np.ndarray, table: list[np.ndarray]) -> None:
        self.values, self.ahead, self.back, self.table = values, ahead, back, table

    @classmethod
    def of(cls, values: np.ndarray) -> Minima:
        n = -(-max(1, len(values)) // cls.SIZE) * cls.SIZE
        full = np.full(n, np.iinfo(np.int32).max, np.int32)
        full[: len(values)] = values
        rows = full.reshape(-1, cls.SIZE)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        table, step = [rows.min(1)], 1
        while 2 * step <= len(table[0]):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        return cls(full, ahead, back, table)

    def write(self, folder: str) -> None:
        np.savez(f"{folder}/table.npz", *self.table)
        for name in ("values", "ahead", "back"):
            getattr(self, name).tofile(f"{folder}/{name}")

    @classmethod
    def read(cls, folder: str) -> Minima:
        with np.load(f"{folder}/table.npz") as z:
            table = [z[f"arr_{k}"] for k in range(len(z.files))]
        return cls(*(np.memmap(f"{folder}/{n}", np.int32, "r") for n in ("values", "ahead", "back")), table)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of values[a : b + 1], for each."""
        x, y = a // self.SIZE, b // self.SIZE
        out = np.minimum(self.back[a], self.ahead[b])
        far = np.flatnonzero(y - x > 1)
        if len(far):
            level = np.log2((y - x - 1)[far]).astype(np.int64)  # counts of blocks are exact in a double
            for k in np.unique(level).tolist():
                on = far[level == k]
                t = self.table[k]
                out[on] = np.minimum(out[on], np.minimum(t[x[on] + 1], t[y[on] - (1 << k)]))
        near = np.flatnonzero(x == y)
        if len(near):
            p, least = a[near], self.values[a[near]].copy()
            open_ = np.flatnonzero(p < b[near])
            while len(open_):
                p[open_] += 1
                least[open_] = np.minimum(least[open_], self.values[p[open_]])
                open_ = open_[p[open_] < b[near][open_]]
            out[near] = least
        return out


@lru_cache(maxsize=1)
def _view(m: Mapped) -> View:
    return View(m)


def ordered(v: View, at: np.ndarray, limit: np.ndarray, by_anchors: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at (ascending) in the order of the codes up to limit: the order, common prefixes with the one before (0 for the first), and which ones are equal to the one before. Equal ones keep their order."""
    n = len(at)
    order = np.arange(n)
    lcp, same = np.zeros(n, np.int64), np.zeros(n, bool)
    if n < 2:
        return order, lcp, same
    new = np.zeros(n, bool)
    new[0] = True
    tied, group, depth = np.arange(n), np.zeros(n, np.int64), 0
    anchor = need = None  # of places as in at
    reach = v.m.window + v.per
    while len(tied):
        which = order[tied]
        if by_anchors and v.rank is not None and len(v.rank) and depth >= reach:
            if anchor is None:
                anchor, need = np.full(n, -1, np.int64), np.full(n, np.iinfo(np.int64).max)
                mine = np.sort(which)
                next_ = np.searchsorted(v.anchors, at[mine])
                inside = next_ < len(v.anchors)
                mine, next_ = mine[inside], next_[inside]
                place = v.anchors[next_]
                inside = place < limit[mine]
                mine, next_, place = mine[inside], next_[inside], place[inside]
                anchor[mine], need[mine] = next_, place - at[mine] + reach
            ready = need[which] <= depth
            if ready.any():
                mine = tied[ready]
                who, g = which[ready], group[mine]
                rank = v.rank[anchor[who]].astype(np.int64)
                by = np.lexsort((rank, g))
                who, g, rank = who[by], g[by], rank[by]
                order[mine] = who
                inner = np.flatnonzero(g[1:] == g[:-1])
                first, second = rank[inner], rank[inner + 1]
                lcp[mine[inner + 1]] = v.anchors[anchor[who[inner + 1]]] - at[who[inner + 1]] + v.least.between(first + 1, second)
                new[mine[inner + 1]] = True
                tied = tied[~ready]
                if not len(tied):
                    break
                which = order[tied]
        g = group[tied]
        chars = v.per if depth == 0 else max(1, min(v.per, (64 - int(g[-1]).bit_length()) // v.bits))
        packed = v.key(at[which], limit[which], depth)
        if chars < v.per:
            packed >>= _U(v.bits * (v.per - chars))
            packed |= g.astype(_U) << _U(v.bits * chars)
        by = np.argsort(packed)
        packed = packed[by]
        which = which[by]
        order[tied] = which
        differ = packed[1:] ^ packed[:-1]
        # neighbours in one group that part here
        part = np.flatnonzero(differ) + 1
        part = part[~new[tied[part]]]
        lcp[tied[part]] = depth + v.lead(differ[part - 1], chars)
        new[tied[part]] = True
        first = new[tied]
        ended = (packed & _U((1 << v.bits) - 1)) == 0
        again = _groups(first) > 1
        equal = again & ended
        if equal.any():
            k = np.flatnonzero(equal)
            number = np.cumsum(first)[k]
            by = np.lexsort((which[k], number))
            order[tied[k]] = which[k][by]
            rest = k[~first[k]]
            same[tied[rest]] = True
            lcp[tied[rest]] = (limit - at)[order[tied[rest]]]
        keep = again & ~ended
        tied = tied[keep]
        if len(tied):
            group[tied] = np.cumsum(new[tied])
        depth += chars
    return order, lcp, same


def _anchors(code: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, window: int) -> np.ndarray:
    """Places whose hash is at most that of the window - 1 next ones, all words within the text."""
    n, per = len(code), 8 // width
    padded = np.zeros(n * width + _PAD, np.uint8)
    padded[: n * width] = code.view(np.uint8)
    words = np.ndarray((n,), ">u8", padded, 0, (width,))
    h = _spread(words.astype(_U))
    least, size = h.copy(), 1
    while size < window:
        step = min(size, window - size)
        np.minimum(least[:-step], least[step:], out=least[:-step])
        size += step
    ok = h == least
    # the last places of each text are none
    reach = window + per
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(begin, end - reach + 1), 1)
    np.add.at(edge, end + 1, -1)
    ok &= np.cumsum(edge[:-1]) == 0
    return np.flatnonzero(ok)


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, places = np.zeros(0x110000, bool), 0
    for part in (x for batch in batches for x in slices(batch, 0)):
        texts = part.column(0).to_pylist()
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        places += len(flat) + len(texts)
        seen[np.flatnonzero(np.bincount(flat))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(seen).tolist()], pa.list_(pa.int32())), pa.array([places], pa.int64())], ["kinds", "places"])


def _encode(folder: str, kinds: tuple[int, ...], width: int, window: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        name = uuid.uuid4().hex  # of its own for each attempt: only that of the one that counts comes back
        table = np.zeros(max(kinds, default=0) + 1, f">u{width}")
        table[list(kinds)] = np.arange(1, len(kinds) + 1)
        base = docs = nulls = 0
        with open(f"{folder}/{name}.codes", "wb") as codes, open(f"{folder}/{name}.ends", "wb") as ends, open(f"{folder}/{name}.ids", "wb") as ids, open(f"{folder}/{name}.anchors", "wb") as anchors:
            for part in (x for batch in batches for x in slices(batch, 1)):
                texts = part.column(1).to_pylist()
                length = np.array([len(t) for t in texts], np.int64)
                end = np.cumsum(length + 1) - 1
                code = table[np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")] if kinds else np.zeros(len(texts), table.dtype)
                code[end] = 0
                codes.write(code.tobytes())
                ends.write((end + base).tobytes())
                ids.write(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                anchors.write((_anchors(code, end - length, end, width, window) + base).tobytes())
                base, docs, nulls = base + len(code), docs + len(texts), nulls + part.column(0).null_count
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "name": name, "places": base, "docs": docs, "nulls": nulls}])

    return encode


def _once(spark: SparkSession, run) -> None:
    """run() in one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            run()
            yield pa.RecordBatch.from_pylist([{"done": True}])

    spark.range(1, numPartitions=1).mapInArrow(task, "done boolean").collect()


def _join(folder: str, parts: list[tuple[str, int]]):
    def join() -> None:
        with open(f"{folder}/codes", "wb") as out:
            for name, _ in parts:
                with open(f"{folder}/{name}.codes", "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 22)
            out.write(b"\0" * _PAD)
        for kind in ("ends", "ids", "anchors"):
            base = 0
            with open(f"{folder}/{kind}", "wb") as out:
                for name, places in parts:
                    numbers = np.fromfile(f"{folder}/{name}.{kind}", np.int64)
                    out.write((numbers if kind == "ids" else numbers + base).tobytes())
                    base += places
        for name, _ in parts:
            for kind in ("codes", "ends", "ids", "anchors"):
                os.unlink(f"{folder}/{name}.{kind}")

    return join


class Powers:
    """Powers of a base, by index."""

    def __init__(self, base: np.uint64) -> None:
        self.low, self.high = self._run(base), None
        self.high = self._run((self.low[-1:] * base)[0])

    @staticmethod
    def _run(base: np.uint64) -> np.ndarray:
        out = np.full(1 << 16, base)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        return self.low[k & 0xFFFF] * self.high[k >> 16]


@lru_cache(maxsize=1)
def _symbols(m: Mapped) -> Block:
    """The anchors' symbols as a block. A text's last symbol takes in its end, so two texts that agree end together, and no end is needed behind it."""
    symbol, last = np.memmap(f"{m.folder}/symbol", np.int32, "r"), np.fromfile(f"{m.folder}/last", np.int64)
    block = Block(None, symbol, np.append(0, last[:-1] + 1), last, np.broadcast_to(np.int64(0), len(symbol) + 1))
    block._hash = np.memmap(f"{m.folder}/sums", _U, "r"), Powers(_BASE)
    return block


def _anchor_key(v: View, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors k, where their symbols end, and their texts' ends. A symbol ends where what makes the next anchor ends: none begins another."""
    at = v.anchors[k]
    end = v.end[v.doc(at)]
    ahead = np.minimum(k + 1, len(v.anchors) - 1)
    following = np.where(ahead > k, v.anchors[ahead], end)
    return at, np.where(following < end, np.minimum(following + v.m.window + v.per, end), end), end


def _deal_anchors(m: Mapped, s1: np.ndarray, s2: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _view(m)
        for chunk in (x for batch in batches for x in batch.column(0).to_pylist()):
            k = np.arange(chunk * CHUNK, min(len(v.anchors), (chunk + 1) * CHUNK))
            at, limit, _ = _anchor_key(v, k)
            number = _below(v, at, limit, s1, s2, None)
            by = np.argsort(number, kind="stable")
            yield _rows(k[by] - chunk * CHUNK, number[by], chunk)

    return deal


def _name_symbols(m: Mapped, before: dict[int, int]):
    def name(rows: pa.Table) -> pa.Table:
        v, k = _view(m), _places(rows)
        at, limit, _ = _anchor_key(v, k)
        order, _, same = ordered(v, at, limit, False)
        out = np.memmap(f"{m.folder}/symbol", np.int32, "r+")
        out[k[order]] = before[rows["range"][0].as_py()] + np.cumsum(~same)  # not all numbers are used
        out.flush()
        return pa.table({"n": pa.array([len(k)], pa.int64())})

    return name


def _sum_symbols(m: Mapped):
    def sum_symbols() -> None:
        v = View(m)
        symbol, powers = np.memmap(f"{m.folder}/symbol", np.int32, "r"), Powers(_BASE)
        carry, docs = _U(0), -1
        with open(f"{m.folder}/sums", "wb") as sums, open(f"{m.folder}/last", "wb") as last:
            sums.write(np.zeros(1, _U).tobytes())
            for k in range(0, len(symbol), CHUNK):
                i = np.arange(k, min(len(symbol), k + CHUNK))
                run = np.cumsum(_spread(symbol[i].astype(_U) + _SALT[7]) * powers[i]) + carry
                carry = run[-1]
                sums.write(run.tobytes())
                doc = v.doc(v.anchors[i])
                ends = i[1:][doc[1:] != doc[:-1]] - 1
                if k and doc[0] != docs:
                    ends = np.append(k - 1, ends)
                docs = doc[-1]
                last.write(ends.astype(np.int64).tobytes())
            last.write(np.array([len(symbol) - 1], np.int64).tobytes())

    return sum_symbols


def _agree(v: View, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Characters that places of suffixes that differ have in common, word by word."""
    out, k = np.zeros(len(i), np.int64), np.arange(len(i))
    stop_i, stop_j, offset = v.end[v.doc(i)], v.end[v.doc(j)], 0
    while len(k):
        more = v.lead(v.key(i, stop_i, offset) ^ v.key(j, stop_j, offset), v.per)
        out[k] += more
        on = more == v.per
        i, j, k, stop_i, stop_j = i[on], j[on], k[on], stop_i[on], stop_j[on]
        offset += v.per
    return out


def _rank_symbols(m: Mapped, before: dict[int, int]):
    def rank(rows: pa.Table) -> pa.Table:
        v, block, k = _view(m), _symbols(m), _places(rows)
        place, common = suffix_order(block, k)
        first = before[rows["range"][0].as_py()]
        out = np.memmap(f"{m.folder}/rank", np.int32, "r+")
        out[place] = np.arange(first, first + len(place))
        out.flush()
        # characters in common: those of equal symbols, and of the first that differ
        p, q = place[1:] + common[1:], place[:-1] + common[1:]
        start = v.anchors[place[1:]]
        over = block.code[p] == block.code[q]
        lcp = np.where(over, v.end[v.doc(start)], v.anchors[p]) - start
        n = np.flatnonzero(~over)
        lcp[n] += _agree(v, v.anchors[p[n]], v.anchors[q[n]])
        least = np.memmap(f"{m.folder}/common", np.int32, "r+")
        least[first + 1 : first + len(place)] = lcp
        least.flush()
        return pa.table({"range": rows["range"][:1].cast(pa.int32()), "first": pa.array(v.anchors[place[:1]], pa.int64()), "last": pa.array(v.anchors[place[-1:]], pa.int64())})

    return rank


def _rank_anchors(spark: SparkSession, m: Mapped) -> None:
    """Files of the anchors' ranks and of least common prefixes. Ranges of anchors are sorted by symbols, which are so numbered, then by what symbols follow."""
    v = View(m)
    n = len(v.anchors)
    if not n:
        return
    for name in ("symbol", "rank", "common"):
        with open(f"{m.folder}/{name}", "wb") as out:
            out.truncate(4 * n)
    many = n // ANCHORS
    k = np.unique(np.linspace(0, n - 1, 64 * many + 2).astype(np.int64)) if many else np.zeros(0, np.int64)
    at, limit, _ = _anchor_key(v, k)
    one, two = v.key(at, limit, 0), v.key(at, limit, v.per)
    by = np.lexsort((two, one))[32::64]
    chunks = -(-n // CHUNK)
    dealt, path = cut_path(spark.range(chunks, numPartitions=chunks).mapInArrow(_deal_anchors(m, one[by], two[by]), ROWS))
    before, total = {}, 0
    for r in dealt.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        before[r.range] = total
        total += r.n
    with shuffles_dropped(spark):
        dealt.repartition(many + 1, "range").groupBy("range").applyInArrow(_name_symbols(m, before), "n long").collect()
    _once(spark, _sum_symbols(m))
    with shuffles_dropped(spark):
        found = dealt.repartition(many + 1, "range").groupBy("range").applyInArrow(_rank_symbols(m, before), "range int, first long, last long").collect()
    found.sort(key=lambda r: r.range)
    least = np.memmap(f"{m.folder}/common", np.int32, "r+")
    if len(found) > 1:  # symbols of different ranges differ
        least[[before[r.range] for r in found[1:]]] = _agree(v, np.array([r.first for r in found[1:]]), np.array([r.last for r in found[:-1]]))
    least.flush()
    _once(spark, lambda: Minima.of(np.memmap(f"{m.folder}/common", np.int32, "r")).write(m.folder))
    for name in ("symbol", "common", "sums", "last"):
        os.unlink(f"{m.folder}/{name}")
    drop(spark, path)


def write(corpus: DataFrame) -> Mapped:
    """The files of a corpus, in the order of doc_id (null first)."""
    spark, uri = corpus.sparkSession, new_folder(corpus.sparkSession)
    found = corpus.select("text").mapInArrow(_characters, "kinds array<int>, places long").collect()
    kinds = tuple(sorted({k for r in found for k in r.kinds}))
    places = sum(r.places for r in found)
    m = Mapped(uri, places, 0, 0, kinds, WINDOW)
    placed = corpus.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with shuffles_dropped(spark):
        parts = placed.mapInArrow(_encode(m.folder, kinds, m.width, m.window), "part long, name string, places long, docs long, nulls long").collect()
    parts.sort(key=lambda r: r.part)
    m = Mapped(uri, places, sum(r.docs for r in parts), sum(r.nulls for r in parts), kinds, m.window)
    os.makedirs(m.folder, exist_ok=True)
    _once(spark, _join(m.folder, [(r.name, r.places) for r in parts]))
    _rank_anchors(spark, m)
    return replace(m, ranked=True)


def _splitters(m: Mapped, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sample's places that part ranges: their first two words, and the place. Equal suffixes that end there are parted by place."""
    v = View(m)
    many = m.places // size
    at = np.unique(np.linspace(0, m.places - 1, 64 * many + 2).astype(np.int64)) if many else np.zeros(0, np.int64)
    limit = v.end[v.doc(at)]
    at, limit = at[at < limit], limit[at < limit]
    one, two = v.key(at, limit, 0), v.key(at, limit, v.per)
    by = np.lexsort((at, two, one))[32::64]
    return one[by], two[by], at[by]


#: Places as steps between them, in bytes, of which 255 goes on; n: how many.
ROWS = "range int, chunk int, n long, places binary"


def _below(v: View, at: np.ndarray, limit: np.ndarray, s1: np.ndarray, s2: np.ndarray, s3: np.ndarray | None) -> np.ndarray:
    """How many splitters come before each suffix."""
    one = v.key(at, limit, 0)
    number, above = np.searchsorted(s1, one, "left"), np.searchsorted(s1, one, "right")
    open_ = np.flatnonzero(number < above)
    if len(open_):
        two = v.key(at[open_], limit[open_], v.per)
        ended = (two & _U((1 << v.bits) - 1)) == 0
        place, above = at[open_], above[open_]
        while len(open_):
            j = number[open_]
            less = s2[j] < two
            if s3 is not None:
                less |= (s2[j] == two) & ended & (s3[j] < place)
            number[open_] += less
            on = less & (number[open_] < above)
            open_, two, ended, place, above = open_[on], two[on], ended[on], place[on], above[on]
    return number


def _rows(at: np.ndarray, number: np.ndarray, chunk: int) -> pa.RecordBatch:
    """ROWS of places that are in order of their number, then of themselves."""
    heads = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(at) else np.zeros(0, np.int64)
    step = np.diff(at, prepend=0)
    step[heads] = at[heads]
    full, rest = step // 255, step % 255
    out = np.full(len(step) + int(full.sum()), 255, np.uint8)
    ends = np.cumsum(full + 1)
    out[ends - 1] = rest
    bounds = np.append(heads, len(at))
    cuts = np.append(0, ends)[bounds].tolist()
    rows = [out[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(number[heads], pa.int32()), pa.array([chunk] * len(rows), pa.int32()), pa.array(np.diff(bounds), pa.int64()), pa.array(rows, pa.binary())], ["range", "chunk", "n", "places"])


def _deal(m: Mapped, prefixes: tuple[str, ...], splitters: tuple[np.ndarray, np.ndarray, np.ndarray], ranges: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _view(m)
        coarse = [s[ranges - 1 :: ranges] for s in splitters]  # of each group of ranges the last
        longest = max(map(len, prefixes))
        for chunk in (x for batch in batches for x in batch.column(0).to_pylist()):
            begin, stop = chunk * CHUNK, min(m.places, (chunk + 1) * CHUNK)
            code = np.asarray(v.code[begin : min(m.places, stop + longest)]).astype(np.int32)
            at = np.flatnonzero(buckets(Block(None, code, None, None, np.array(m.kinds)), list(prefixes))[: stop - begin] >= 0) + begin
            number = _below(v, at, v.end[v.doc(at)], *coarse)
            by = np.argsort(number.astype(np.uint16) if len(coarse[0]) < 1 << 16 else number, kind="stable")
            yield _rows(at[by] - begin, number[by], chunk)

    return deal


def _places(rows: pa.Table) -> np.ndarray:
    out = []
    for chunk, packed in sorted(zip(rows["chunk"].to_pylist(), rows["places"].to_pylist(), strict=True)):
        step = np.frombuffer(packed, np.uint8)
        out.append(np.cumsum(step, dtype=np.int64)[step != 255] + chunk * CHUNK)
    return np.concatenate(out)


def _by_range(each, m: Mapped, splitters: tuple[np.ndarray, np.ndarray, np.ndarray], ranges: int):
    """each(range, places) for each range of a group, one after the other."""

    def grouped(rows: pa.Table) -> pa.Table:
        at, group = _places(rows), rows["range"][0].as_py()
        if ranges == 1:
            return each(group, at)
        v, low = _view(m), group * ranges
        mine = [s[low : low + ranges - 1] for s in splitters]
        number = np.concatenate([_below(v, x, v.end[v.doc(x)], *mine) for x in np.array_split(at, -(-len(at) // CHUNK))])
        return pa.concat_tables([each(low + k, at[number == k]) for k in np.unique(number).tolist()])

    return grouped


def _range_of(m: Mapped, prefixes: tuple[str, ...], at: np.ndarray):
    """A range's suffixes in order: places, texts, ends, common prefixes, the number of each one's prefix, and where a prefix begins."""
    v = _view(m)
    doc = v.doc(at)
    limit = v.end[doc]
    order, lcp, _ = ordered(v, at, limit)
    at, doc, limit = at[order], doc[order], limit[order]
    # prefixes are few and in order, and a suffix's is the last one not after it
    names = sorted(range(len(prefixes)), key=lambda k: prefixes[k])
    longest = max(map(len, prefixes))
    text = lambda p, end: "".join(chr(m.kinds[c - 1]) for c in v.code[p : min(end, p + longest)].tolist())
    low, high = 0, len(at)
    number = np.empty(len(at), np.int32)
    sorted_names = [prefixes[k] for k in names]
    while low < high:
        k = bisect.bisect_right(sorted_names, text(int(at[low]), int(limit[low]))) - 1
        # the first suffix from there on that doesn't begin with it
        name = sorted_names[k]
        a, b = low + 1, high
        while a < b:
            mid = (a + b) // 2
            if text(int(at[mid]), int(limit[mid])).startswith(name):
                a = mid + 1
            else:
                b = mid
        number[low:a] = names[k]
        low = a
    begins = np.ones(len(at), bool)
    begins[1:] = number[1:] != number[:-1]
    return v, at, doc, limit, lcp, number, begins


STATS = "range int, prefix string, nodes long, leaves long, max_depth int"


def _stats(m: Mapped, prefixes: tuple[str, ...]):
    def stats(mine: int, at: np.ndarray) -> pa.Table:
        _, at, _, limit, lcp, number, begins = _range_of(m, prefixes, at)
        lcp[begins] = 0
        shape = tree.shape(lcp, begins)
        starts = np.flatnonzero(begins)
        of = np.cumsum(begins) - 1
        inner = np.bincount(of[shape.call], minlength=len(starts))
        leaves = np.diff(np.append(starts, len(at)))
        depth = np.maximum.reduceat(limit - at, starts) + 1
        return pa.table(
            {
                "range": pa.array([mine] * len(starts), pa.int32()),
                "prefix": pa.array([prefixes[k] for k in number[starts].tolist()], pa.string()),
                "nodes": pa.array(inner + leaves, pa.int64()),
                "leaves": pa.array(leaves, pa.int64()),
                "max_depth": pa.array(depth, pa.int32()),
            }
        )

    return stats


def _dealt(spark: SparkSession, m: Mapped, prefixes: tuple[str, ...], each, schema: str) -> list:
    """What each(range, places) gives. Suffixes are sent in groups of neighbouring ranges, as few as will do: the more there are, the longer the steps between places."""
    chunks = -(-m.places // CHUNK)
    splitters = _splitters(m, RANGE_SUFFIXES)
    groups = max(GROUPS, -(-m.places // GROUP_SUFFIXES))
    ranges = -(-(len(splitters[0]) + 1) // groups)
    dealt = spark.range(chunks, numPartitions=chunks).mapInArrow(_deal(m, prefixes, splitters, ranges), ROWS)
    with shuffles_dropped(spark):
        # a task for each group: they differ too much in what they take to be put together
        return dealt.repartition(-(-(len(splitters[0]) + 1) // ranges), "range").groupBy("range").applyInArrow(_by_range(each, m, splitters, ranges), schema).collect()  # rows for ranges and prefixes, some thousands


def _names(prefixes: DataFrame) -> tuple[str, ...]:
    return tuple(r.prefix for r in prefixes.select("prefix").distinct().collect() if r.prefix)


def tree_stats(corpus: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, leaves, max_depth) of each prefix's sub-tree. All suffixes are sorted and all trees built from them, a prefix larger than a range in pieces; their rows aren't written."""
    names = _names(prefixes)
    schema = "prefix string, leaves long, max_depth int"
    if not names:
        return corpus.sparkSession.createDataFrame([], schema)
    m = write(corpus)
    found = _dealt(corpus.sparkSession, m, names, _stats(m, names), STATS)
    drop(corpus.sparkSession, m.uri)
    rows = corpus.sparkSession.createDataFrame([(r.prefix, r.leaves, r.max_depth) for r in found], schema)
    return rows.groupBy("prefix").agg(F.sum("leaves").alias("leaves"), F.max("max_depth").alias("max_depth"))


ARRAY = "prefix string, range int, at long, doc_id long, pos long, lcp int"


def _array(m: Mapped, prefixes: tuple[str, ...], folder: str):
    def array(mine: int, at: np.ndarray) -> pa.Table:
        os.makedirs(folder, exist_ok=True)
        v, at, doc, limit, lcp, number, begins = _range_of(m, prefixes, at)
        starts = np.flatnonzero(begins)
        rank = np.arange(len(at)) - starts[np.cumsum(begins) - 1]
        lcp[begins] = 0
        begin = np.where(doc > 0, v.end[np.maximum(doc - 1, 0)] + 1, 0)
        names = pa.array([prefixes[k] for k in number[starts].tolist()], pa.string())
        out = pa.table(
            {
                "prefix": names.take(pa.array(np.cumsum(begins) - 1)),
                "range": pa.array(np.full(len(at), mine, np.int32)),
                "at": pa.array(rank, pa.int64()),
                "doc_id": pa.array(v.ids[doc], pa.int64(), mask=doc < m.nulls),
                "pos": pa.array(at - begin, pa.int64()),
                "lcp": pa.array(lcp, pa.int32()),
            }
        )
        name = f"{uuid.uuid4().hex}.parquet"
        pyarrow.parquet.write_table(out, f"{folder}/{name}", store_schema=False)
        stops = np.append(starts[1:], len(at)) - 1
        return pa.table(
            {"name": [name] * len(starts), "range": pa.array([mine] * len(starts), pa.int32()), "prefix": names, "n": pa.array(stops - starts + 1, pa.int64()), "first": pa.array(at[starts], pa.int64()), "last": pa.array(at[stops], pa.int64())}
        )

    return array


def _common(v: View, a: int, b: int) -> int:
    """Characters that two places have in common."""
    i, j = np.array([a]), np.array([b])
    stop_i, stop_j = v.end[v.doc(i)], v.end[v.doc(j)]
    most, out = int(min(stop_i[0] - a, stop_j[0] - b)), 0
    while out < most:
        more = int(v.lead(v.key(i, stop_i, out) ^ v.key(j, stop_j, out), v.per)[0])
        out += more
        if more < v.per:
            break
    return min(out, most)


def suffix_array(corpus: DataFrame, prefixes: DataFrame) -> DataFrame:
    """As suffixes.suffix_array."""
    spark, names = corpus.sparkSession, _names(prefixes)
    schema = "prefix string, rank long, doc_id long, pos long, lcp int"
    if not names:
        return spark.createDataFrame([], schema)
    m = write(corpus)
    uri = new_folder(spark)
    found = _dealt(spark, m, names, _array(m, names, uri.removeprefix("file://")), "name string, range int, prefix string, n long, first long, last long")
    # what lies before a range's part of a prefix, and what its first suffix has in common with the last one there
    v, before, last, table = View(m), {}, {}, []
    for r in sorted(found, key=lambda r: r.range):
        table.append((r.prefix, r.range, before.get(r.prefix, 0), _common(v, last[r.prefix], r.first) if r.prefix in last else 0))
        before[r.prefix], last[r.prefix] = before.get(r.prefix, 0) + r.n, r.last
    del v
    drop(spark, m.uri)
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(ARRAY).parquet(*(f"{uri}/{n}" for n in sorted({r.name for r in found})))
    offsets = spark.createDataFrame(table, "prefix string, range int, _before long, _lcp int")
    placed = rows.join(F.broadcast(offsets), ["prefix", "range"])
    return placed.select("prefix", (F.col("at") + F.col("_before")).alias("rank"), "doc_id", "pos", F.when(F.col("at") == 0, F.col("_lcp")).otherwise(F.col("lcp")).alias("lcp"))
