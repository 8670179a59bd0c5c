"""Unbounded n-gram scoring: counts of short runs of words by hash, suffix arrays for what goes on longer.

One pass over the corpus, whatever the number of texts, counts the runs of 1 to SHORT words that end at a word of the texts. A task sends on only those that a filter of the texts' runs lets
through, added up; ranges of their hashes give each place of the texts its counts. Where a run of SHORT words occurs elsewhere, a longer one may. Such passages of the texts
are looked up in the corpus' passages that share a run of SHORT words with them, which the pass has put aside; all else of the corpus can't have a run so long.

There, a task takes passages in shards of SHARD_WORDS words. A shard's suffix array is that of the words backwards, so that what precedes a word, however far back, is a suffix, and the places of
the texts to score are sorted in. The longest context before a word that a shard has is the longer of what the place shares with its neighbours there; binary search in the array
finds the range of all suffixes that begin with it, whose size is how often it occurs. A task keeps, over its shards, the longest context of each place and its count; over the
tasks, the longest of these and the sum of its counts stay. With the same for the next word, that is the probability of a word after its longest context, which is smoothed by that without context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..operators.block import Block
from ..storage import cut, cut_path
from . import words
from .common import col, ranges
from .near import folded

_U = np.uint64
#: Words that a task looks up passages of texts in at once, with these (at least a third is the shard's), and of the texts that are looked up in one go over the passages; a task holds some 80 bytes for each.
SHARD_WORDS, TEXT_WORDS = 3_000_000, 1_500_000
#: Words of the longest runs that are counted by hash; words of a block of texts, at most, whose counts a task holds.
SHORT, BLOCK_WORDS = 5, 250_000
#: Hashes that a task adds up at once; words of a record of passages; ranges of hashes, at most; bits of a task's filter for a run of the texts, and the binary logarithm of all bits, at most.
HASHES, PASSAGE_WORDS, RANGES, RUN_BITS, MOST_BITS = 4_000_000, 1000, 500, 16, 29
#: What a record of the pass holds.
COUNTS, PLACES, PASSAGES, WORDS = range(4)
_RUN_BASE, _KEY_SALT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: Weight of the shorter context's probability, in occurrences.
ALPHA = 1.0


def folded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without case and ASCII punctuation, and where each text's begin."""
    raw, offsets = words.text_buffer(column)
    raw = folded(raw)
    start, end, first = words.word_spans(raw, offsets)
    return words.hash_spans(raw, start, end), first


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the depth entries from there on, by prefix doubling; entries are non-negative and less than 2**31."""
    n = len(a)
    key = a.astype(_U) << _U(32)
    key[:-1] |= a[1:].astype(_U) + _U(1)
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1

    def rerank(at: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks of sorted keys; gives the places in the order that still have an equal."""
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(begins)
        size = np.diff(np.append(begin, len(key)))
        rank[place] = np.repeat(at[begin], size)
        return at[np.repeat(size > 1, size)]

    key = key[order]
    tied = rerank(np.arange(n, dtype=np.int32), order, key)
    del key
    h = 2
    while h < depth and len(tied):
        place = order[tied]
        key = (rank[place].astype(_U) << _U(32)) | (rank[np.minimum(place.astype(np.int64) + h, n)] + 1).astype(_U)
        by = np.argsort(key)
        place, key = place[by], key[by]
        order[tied] = place
        tied = rerank(tied, place, key)
        h *= 2
    return order


def _batches(path: str, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of words, sizes, numbers and keys of the texts in the blocks from low to high - 1."""
    system, root = pyarrow.fs.FileSystem.from_uri(path)
    for file in sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet")):
        table = pyarrow.parquet.ParquetFile(file, filesystem=system)
        at = table.schema_arrow.get_field_index("block")
        bounds = [table.metadata.row_group(g).column(at).statistics for g in range(table.num_row_groups)]
        groups = [g for g, x in enumerate(bounds) if x is None or not x.has_min_max or (x.max >= low and x.min < high)]
        for batch in table.iter_batches(1000, row_groups=groups, columns=["query", "text", "key", "block"]) if groups else ():
            block = batch.column("block").to_numpy()
            mine = batch.filter(pa.array((block >= low) & (block < high)))
            code, first = folded_words(mine.column("text"))
            yield code, np.diff(first), mine.column("query").to_numpy(), mine.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(_U)


class _Texts:
    """Texts to score, or passages of them: hashes of their words, where each begins, keys that tell documents apart."""

    def __init__(self, code: np.ndarray, size: np.ndarray, query: np.ndarray, key: np.ndarray) -> None:
        self.code, self.size, self.query, self.key = code, size, query, key
        self.by_key = np.argsort(self.key, kind="stable")
        self.keys = self.key[self.by_key]
        #: The text that stands for all of its key, which are equal.
        self.lead = np.where(self.key == 0, np.arange(len(self.key)), self.owner(self.key))

    @classmethod
    def read(cls, path: str, low: int, high: int) -> _Texts:
        none = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))]
        return cls(*(np.concatenate(x) for x in zip(*none, *_batches(path, low, high), strict=True)))

    def owner(self, key: np.ndarray) -> np.ndarray:
        """The first text with the key, which isn't 0; -1: there is none."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (key != 0), self.by_key[at], -1)


def _edge(block: Block, order: np.ndarray, at: np.ndarray, rank: np.ndarray, length: np.ndarray, side: int) -> np.ndarray:
    """The outermost place of the array, towards side, whose suffix begins with the first `length` entries from at; at itself has that rank."""
    sums, power = block.hashes()
    n = len(order)
    good, bad = rank.copy(), np.full(len(rank), -1 if side < 0 else n)
    open_ = np.flatnonzero(np.abs(good - bad) > 1)
    step = 1
    while len(open_):
        g, b = good[open_], bad[open_]
        half = np.abs(g - b) >> 1
        test = g + side * np.maximum(1, np.minimum(half, step))
        x, m = at[open_], length[open_]
        y = order[test].astype(np.int64)
        inside = y + m <= n
        y = np.where(inside, y, x)
        first, last = np.minimum(x, y), np.maximum(x, y)
        same = inside & ((sums[first + m] - sums[first]) * power[last - first] == sums[last + m] - sums[last])
        good[open_[same]] = test[same]
        bad[open_[~same]] = test[~same]
        open_ = open_[np.abs(good[open_] - bad[open_]) > 1]
        step *= 2
    return good


def matches(code: np.ndarray, size: np.ndarray, owner: np.ndarray, texts: _Texts, least: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of texts, in a shard of documents with these words: the longest run of words ending there that the shard has, how often it has that run, and the word.

    owner: the text that a document is itself (-1: none); its places count for nothing at the text's same places. least: runs shorter than that are of no interest.
    """
    d, total = len(size), len(texts.code)
    ids, kinds = pd.factorize(np.concatenate([code, texts.code]))
    ids = ids.astype(np.int32)
    sizes = np.concatenate([size, texts.size])
    length = sizes + 1
    begin = np.cumsum(length) - length
    end = begin + sizes
    n = int(length.sum())
    text = np.empty(n, np.int32)
    document = np.repeat(np.arange(len(sizes), dtype=np.int32), length)
    there = ranges(begin, sizes)
    text[(begin + end - 1)[document[there]] - there] = ids + 1
    del there
    text[end] = len(kinds) + 1 + np.arange(len(sizes))  # an end of its own for each
    order = suffix_array(text, n)
    places = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = places
    mine = np.zeros(n, bool)
    mine[: int(length[:d].sum())] = True
    mine[end[:d]] = False
    block = Block(pa.nulls(0), text, begin, end, np.arange(len(kinds) + len(sizes)))
    row = np.repeat(np.arange(len(texts.size)), texts.size)
    lead = texts.lead[row]
    q_end = end[d + row]
    at = q_end - 1 - (np.arange(total) - (np.cumsum(texts.size) - texts.size)[row])
    at_rank = rank[at].astype(np.int64)
    del rank
    is_mine = mine[order]
    del mine
    before = np.maximum.accumulate(np.where(is_mine, places, np.int32(-1)))
    behind = np.minimum.accumulate(np.where(is_mine, places, np.int32(n))[::-1])[::-1]
    del places
    sums, power = block.hashes()
    own = np.append(owner, np.full(len(texts.size), -1))

    def nearest(near: np.ndarray, side: int) -> np.ndarray:
        """The common run with the nearest suffix of the shard on that side."""
        found = near[at_rank].astype(np.int64)
        while True:
            ok = (found >= 0) & (found < n)
            x = order[np.where(ok, found, 0)].astype(np.int64)
            twin = ok & (own[document[x]] == lead) & (end[document[x]] - x == q_end - at)
            if not twin.any():
                break
            step = found[twin] + side
            found[twin] = np.where((step >= 0) & (step < n), near[np.clip(step, 0, n - 1)], -1)
        most = np.where(ok, np.minimum(q_end - at, end[document[x]] - x), 0)
        # a run as long as asked for is tested at once; only where there is one its whole length matters
        m = np.minimum(least, most)
        first, last = np.minimum(at, x), np.maximum(at, x)
        on = np.flatnonzero((most >= least) & ((sums[first + m] - sums[first]) * power[last - first] == sums[last + m] - sums[last]))
        found = np.zeros(total, np.int64)
        found[on] = block.common(at[on], x[on], most[on], m[on], step=1)
        return found

    longest = np.maximum(nearest(before, -1), nearest(behind, 1))
    del before, behind, document
    twins = np.bincount(owner[owner >= 0], minlength=len(texts.size))[lead]
    running = np.concatenate([np.zeros(1, np.int32), np.cumsum(is_mine, dtype=np.int32)])
    single = np.bincount(ids[: len(code)], minlength=len(kinds))[ids[len(code) :]] - twins
    count = np.where(longest == 1, single, 0)
    some = np.flatnonzero((longest > 1) & (longest >= least))
    low = _edge(block, order, at[some], at_rank[some], longest[some], -1)
    high = _edge(block, order, at[some], at_rank[some], longest[some], 1)
    count[some] = running[high + 1].astype(np.int64) - running[low] - twins[some]
    return longest, count, single


def _planes(x: np.ndarray) -> bytes:
    """The numbers, below 2**40, byte by byte."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _found(data: bytes) -> np.ndarray:
    """Three rows: longest runs, their counts, the words' counts."""
    raw = np.frombuffer(data, np.uint8).reshape(3, 5, -1)
    out = np.zeros((3, raw.shape[2], 8), np.uint8)
    out[:, :, :5] = raw.transpose(0, 2, 1)
    return out.view("<i8").reshape(3, -1)


class _Filter:
    """Lets through all hashes that were added, and few others."""

    def __init__(self, n: int) -> None:
        bits = min(max(int(n * RUN_BITS).bit_length(), 16), MOST_BITS)
        self.mask, self.table = _U((1 << bits) - 1), np.zeros(1 << (bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes & self.mask
        np.bitwise_or.at(self.table, (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.table[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _found_in(hashes: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of the hashes is in the sorted ones, and where."""
    if not len(sorted_):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
    return sorted_[at] == hashes, at


def _short_runs(code: np.ndarray, size: np.ndarray, keep: Callable[[np.ndarray], np.ndarray] | None = None, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) for n from least to SHORT: the runs of n words, within a text, that end at the places. keep: of the runs asked about, which stay; what ends in none of them isn't made longer."""
    at = np.arange(len(code))
    depth = (at - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    value = code
    for n in range(1, SHORT + 1):
        if n > 1:
            longer = depth[at] >= n - 1
            at = at[longer]
            value = value[longer] * _RUN_BASE + code[at - (n - 1)]
        if n < least:
            continue
        hashes = words.mix(value + _U(n))
        if keep is not None:
            some = keep(hashes)
            at, value, hashes = at[some], value[some], hashes[some]
        yield n, at, hashes


def _passages(code: np.ndarray, size: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, text and place in the text of what runs of SHORT words that end at ends cover; words next to each other in a text are one passage."""
    change = np.zeros(len(code) + 1, np.int32)
    np.add.at(change, ends - (SHORT - 1), 1)
    np.add.at(change, ends + 1, -1)
    covered = np.cumsum(change[:-1]) > 0
    begin = np.cumsum(size) - size
    heads = np.zeros(len(code) + 1, bool)
    heads[begin] = True
    starts = covered & heads[:-1]
    starts[1:] |= covered[1:] & ~covered[:-1]
    stops = covered.copy()
    stops[:-1] &= ~covered[1:] | heads[1:-1]
    start, stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    text = np.searchsorted(begin, start, "right") - 1
    return start, stop - start, text, start - begin[text]


def _long_passages(code: np.ndarray, size: np.ndarray, long_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_passages() of the runs of SHORT words whose hashes are among the sorted long_."""
    for _, at, hashes in _short_runs(code, size, least=SHORT):
        found = _passages(code, size, at[_found_in(hashes, long_)[0]])
    return found


def _passage_keys(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Tells apart the passages of documents with these keys; 0 stays."""
    return np.where(key == 0, _U(0), words.mix(key + (place.astype(_U) + _U(1)) * _KEY_SALT) | _U(1))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["range", "kind", "block", "n", "a", "b"])


_RECORD = "range int, kind int, block int, n long, a binary, b binary"


def _in_ranges(hashes: np.ndarray, n_ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes."""
    cuts = np.searchsorted(((hashes >> _U(32)) * _U(n_ranges)) >> _U(32), np.arange(n_ranges + 1, dtype=_U))
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def _ask(path: str, n_ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs at the places of each block of texts: the run of n words at place i has the number (n - 1) * words + i; behind these come the texts' keys."""
        for block in (b for batch in batches for b in batch.column(0).to_pylist()):
            texts = _Texts.read(path, block, block + 1)
            n = len(texts.code)
            own = np.flatnonzero(texts.key != 0)
            asked = [(hashes, at + (k - 1) * n) for k, at, hashes in _short_runs(texts.code, texts.size)] + [(words.mix(texts.key[own] ^ _KEY_SALT), own + SHORT * n)]
            hashes, place = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.argsort(hashes)
            hashes, place = hashes[order], place[order]
            yield _records([(0, PLACES, block, None, b"", b"")])  # a block is answered even if nothing of it is found
            for k, a, b in _in_ranges(hashes, n_ranges):
                yield _records([(k, PLACES, block, None, hashes[a:b].tobytes(), place[a:b].astype(np.int64).tobytes())])

    return ask


def _survey(path: str, total: int, blocks: int, n_ranges: int):
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of documents (key, text): how often runs of the texts occur, and the passages that may have longer ones."""
        wanted, keys = _Filter((total + 1) * SHORT), [np.zeros(0, _U)]
        for code, size, _, key in _batches(path, 0, blocks):
            for _, _, hashes in _short_runs(code, size):
                wanted.add(hashes)
            keys.append(key[key != 0])
        keys = np.unique(np.concatenate(keys))
        held, n_held, n_words, turn = [], 0, 0, 0

        def added_up() -> pa.RecordBatch:
            hashes = np.concatenate(held)
            held.clear()
            hashes.sort()
            begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            count = np.diff(np.append(begin, len(hashes)))
            hashes = hashes[begin]
            return _records([(k, COUNTS, None, None, hashes[a:b].tobytes(), count[a:b].astype(np.int32).tobytes()) for k, a, b in _in_ranges(hashes, n_ranges)])

        for part in (x for batch in batches for x in slices(batch, 1)):
            code, first = folded_words(part.column(1))
            size = np.diff(first)
            key = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            key = np.where(_found_in(key, keys)[0], key, _U(0))
            n_words += len(code)
            own = words.mix(key[key != 0] ^ _KEY_SALT)
            held.append(own)
            n_held += len(own)
            for _, at, hashes in _short_runs(code, size, wanted.has):
                held.append(hashes)
                n_held += len(hashes)
            start, length, text, place = _passages(code, size, at)
            sent = np.cumsum(length)
            a = 0
            while a < len(start):
                b = max(a + 1, int(np.searchsorted(sent, (sent[a - 1] if a else 0) + PASSAGE_WORDS, "right")))
                turn += 1
                yield _records([(turn % n_ranges, PASSAGES, None, None, code[ranges(start[a:b], length[a:b])].tobytes(), np.stack([length[a:b].astype(np.int64), place[a:b].astype(np.int64), key[text[a:b]].view(np.int64)]).tobytes())])
                a = b
            if n_held >= HASHES:
                yield added_up()
                n_held = 0
        if n_held:
            yield added_up()
        yield _records([(0, WORDS, None, n_words, None, None)])

    return survey


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist())])


def _meet(table: pa.Table) -> pa.Table:
    """A range's counts at the places that ask for them; other records go through."""
    kind = table["kind"].to_numpy()
    counted = table.filter(pa.array(kind == COUNTS))
    hashes, count = _joined(counted["a"], _U), _joined(counted["b"], np.int32).astype(np.int64)
    order = np.argsort(hashes)
    hashes, count = hashes[order], count[order]
    if len(hashes):
        begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        hashes, count = hashes[begin], np.add.reduceat(count, begin)
    answers = []
    for row in table.filter(pa.array(kind == PLACES)).to_pylist():
        there, at = _found_in(np.frombuffer(row["a"], _U), hashes)
        answers.append((row["range"], PLACES, row["block"], None, np.frombuffer(row["b"], np.int64)[there].tobytes(), count[at[there]].tobytes() if len(hashes) else b""))
    through = table.filter(pa.array(kind >= PASSAGES))
    return pa.concat_tables([pa.Table.from_batches([_records(answers)]), through.cast(_records([]).schema)])


def _short(path: str):
    def short(table: pa.Table) -> pa.Table:
        """Of a block's texts, what _found() reads, with runs of less than SHORT words; in a row of number -1 the hashes of runs of SHORT words that occur elsewhere, and how many words these cover."""
        block = table["block"][0].as_py()
        texts = _Texts.read(path, block, block + 1)
        n = len(texts.code)
        count = np.zeros(SHORT * n + len(texts.size), np.int64)
        for place, c in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            count[np.frombuffer(place, np.int64)] = np.frombuffer(c, np.int64)
        twins = np.repeat(count[SHORT * n :], texts.size)
        count = count[: SHORT * n].reshape(SHORT, n) - twins
        best = np.zeros((3, n), np.int64)
        for k in range(1, SHORT):
            more = count[k - 1] > 0
            best[0, more], best[1, more] = k, count[k - 1, more]
        best[2] = count[0]
        long_ = np.unique(np.concatenate([h[count[SHORT - 1, at] > 0] for _, at, h in _short_runs(texts.code, texts.size, least=SHORT)]))
        covered = int(_long_passages(texts.code, texts.size, long_)[1].sum())
        ends = np.cumsum(texts.size)
        data = [b"".join(_planes(x[b - m : b]) for x in best) for b, m in zip(ends, texts.size, strict=True)]
        return pa.table(
            [pa.array([block] * (len(data) + 1), pa.int32()), pa.array([-1, *texts.query.tolist()], pa.int64()), pa.array([covered] + [None] * len(data), pa.int64()), pa.array([long_.tobytes(), *data], pa.binary())],
            names=["block", "query", "covered", "data"],
        )

    return short


def _long(path: str, set_path: str, low: int, high: int, shard_words: int):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of SHORT words and more in records of passages: for each text that has such, what _found() reads, with 0 where there is none."""
        system, root = pyarrow.fs.FileSystem.from_uri(set_path)
        sets = [np.zeros(0, _U)]
        for file in (f.path for f in system.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet")):
            for row in pyarrow.parquet.ParquetFile(file, filesystem=system).read(columns=["block", "data"]).to_pylist():
                if low <= row["block"] < high:
                    sets.append(np.frombuffer(row["data"], _U))
        long_ = np.unique(np.concatenate(sets))
        # query, words of the whole text and place in it, for each passage of the texts
        codes, sizes, keys, query, whole, where = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for code, size, number, key in (x for block in range(low, high) for x in _batches(path, block, block + 1)):
            start, length, text, place = _long_passages(code, size, long_)
            for held, x in ((codes, code[ranges(start, length)]), (sizes, length), (keys, _passage_keys(key[text], place)), (query, number[text]), (whole, size[text]), (where, place)):
                held.append(x)
        query, whole, where = np.concatenate(query), np.concatenate(whole), np.concatenate(where)
        texts = _Texts(np.concatenate(codes), np.concatenate(sizes), query, np.concatenate(keys))
        best = np.zeros((3, len(texts.code)), np.int64)

        def searched(codes: list[np.ndarray], sizes: list[np.ndarray], keys: list[np.ndarray]) -> None:
            owner = texts.owner(np.concatenate(keys))
            longest, count, _ = matches(np.concatenate(codes), np.concatenate(sizes), owner, texts, np.maximum(best[0], SHORT))
            more, same = longest > best[0], (longest == best[0]) & (longest > 0)
            best[1] = np.where(more, count, np.where(same, best[1] + count, best[1]))
            best[0] = np.maximum(best[0], longest)

        codes, sizes, keys, held = [], [], [], 0
        for a, b in (x for batch in batches for x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            code, (size, offset, key) = np.frombuffer(a, _U), np.frombuffer(b, np.int64).reshape(3, -1)
            start, length, text, place = _long_passages(code, size, long_)
            codes.append(code[ranges(start, length)])
            sizes.append(length)
            keys.append(_passage_keys(key.view(_U)[text], offset[text] + place))
            held += int(length.sum())
            if held >= max(shard_words - len(texts.code), shard_words // 3):
                searched(codes, sizes, keys)
                codes, sizes, keys, held = [], [], [], 0
        if held:
            searched(codes, sizes, keys)
        ends = np.cumsum(texts.size)
        cuts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(query)), strict=True):
            full = np.zeros((3, whole[a]), np.int64)
            for k in range(a, b):
                full[:2, where[k] : where[k] + texts.size[k]] = best[:2, ends[k] - texts.size[k] : ends[k]]
            yield pa.RecordBatch.from_arrays([pa.array(query[a : a + 1]), pa.array([b"".join(_planes(x) for x in full)], pa.binary())], ["query", "data"])

    return look_up


def _scored(total: int, alpha: float):
    def scored(table: pa.Table) -> pa.Table:
        each = [_found(x) for x in table["data"].to_pylist()]
        longest = np.max([x[0] for x in each], axis=0)
        count = np.sum([np.where(x[0] == longest, x[1], 0) for x in each], axis=0)
        single = np.sum([x[2] for x in each], axis=0)
        base = (single + alpha / (total + 1)) / (total + alpha)
        context = np.concatenate([[0], longest[:-1]])[: len(longest)]
        c = np.concatenate([[0], count[:-1]])[: len(longest)]
        goes_on = np.where(longest == context + 1, count, 0)
        chance = np.where(context > 0, (goes_on + alpha * base) / (c + alpha), base)
        n = len(longest)
        sums = [float(np.log(chance).sum()), float(context.mean()), int(context.max())] if n else [0.0, None, None]
        names = ["query", "log_prob", "mean_context", "longest_context"]
        return pa.table([table["query"].slice(0, 1), pa.array([sums[0]], pa.float64()), pa.array([sums[1]], pa.float64()), pa.array([sums[2]], pa.int32())], names=names)

    return scored


def _text_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 1)):
        _, first = folded_words(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first))], ["query", "n_words"])


def _key(df: DataFrame, id_col: str, text_col: str):
    """Tells documents apart by id and text; 0 without an id."""
    key = col(df, id_col).cast("long")
    return F.when(key.isNull(), F.lit(0)).otherwise(F.xxhash64(key, col(df, text_col).cast("string"))).cast("long")


def _goes(covered: list[tuple[int, int]], text_words: int) -> list[tuple[int, int]]:
    """From which block to which passages are looked up in one go; covered: the blocks in order, with the words that their passages have."""
    goes, low, sum_ = [], 0, 0
    for block, n in covered:
        if sum_ and sum_ + n > text_words:
            goes.append((low, block))
            low, sum_ = block, 0
        sum_ += n
    return [*goes, (low, covered[-1][0] + 1)] if sum_ else goes


def score(
    texts: DataFrame, corpus: DataFrame, id_col: str = "item_id", text_col: str = "text", corpus_text_col: str = "text", alpha: float = ALPHA, shard_words: int = SHARD_WORDS, own_col: str | None = None, text_words: int = TEXT_WORDS
) -> DataFrame:
    """(id_col, n_words, log_prob, perplexity, mean_context, longest_context) of each row of texts under the n-grams of all of corpus.

    Words are compared without case and ASCII punctuation. A word's context x is the longest run of words before it, within its text, that the corpus has within
    one document. With c(x) for the occurrences of x and N for the corpus' words, the probability of w is p(w) = (c(w) + alpha / (N + 1)) / (N + alpha)
    without context, else (c(xw) + alpha p(w)) / (c(x) + alpha). Natural logarithms; figures rounded to 6 digits. A text, of any length, that is null or has no word has
    n_words 0, log_prob 0 and null averages. Null ids stay; repeated rows get equal answers. Null texts of the corpus count for nothing; an empty corpus
    gives each word the probability 1. An empty table of texts gives no rows.

    own_col: the column of corpus with its documents' ids, where texts are some of them. The scored occurrence itself then counts for nothing, nor among N: the place that the text has in rows with
    its id and text; in texts without an id, all counts. The corpus is read once. Only for passages of SHORT words and more that occur in both does time grow with the words of texts times those
    of corpus: each TEXT_WORDS of such passages of texts are looked up in all such passages of corpus.
    """
    spark = texts.sparkSession
    plain = texts.select(col(texts, id_col).cast("long").alias("out_id"), F.coalesce(col(texts, text_col).cast("string"), F.lit("")).alias("text"), (_key(texts, id_col, text_col) if own_col else F.lit(0).cast("long")).alias("key"))
    numbered = cut(plain.withColumn("query", F.monotonically_increasing_id()))
    length = cut(numbered.select("query", "text").mapInArrow(_text_depth, "query long, n_words long"))
    total = length.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-total // min(text_words, BLOCK_WORDS)))
    # a block's rows lie together, so that its readers pass over most of the others
    queries, path = cut_path(numbered.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block"))
    own = _key(corpus, own_col, corpus_text_col) if own_col else F.lit(0).cast("long")
    documents = corpus.select(own.alias("key"), col(corpus, corpus_text_col).cast("string").alias("text")).where("text is not null")
    n_ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)
    documents = documents.coalesce(spark.sparkContext.defaultParallelism)  # a task makes one filter
    surveyed = documents.mapInArrow(_survey(path, total, blocks, n_ranges), _RECORD)
    asked = spark.range(0, blocks, 1, min(blocks, spark.sparkContext.defaultParallelism)).mapInArrow(_ask(path, n_ranges), _RECORD)
    met = cut(surveyed.unionByName(asked).groupBy("range").applyInArrow(_meet, _RECORD))
    held = met.where(F.col("kind") == WORDS).agg(F.sum("n")).first()[0] or 0
    answers = met.where(F.col("kind") == PLACES).select("block", "a", "b")
    short = cut(answers.groupBy("block").applyInArrow(_short(path), "block int, query long, covered long, data binary"))
    parts = short.where(F.lit(held > 0) & (F.col("query") >= 0)).select("query", "data")
    sets, set_path = cut_path(short.where("query = -1").select("block", "covered", "data"))
    passages = met.where(F.col("kind") == PASSAGES).select("a", "b").coalesce(spark.sparkContext.defaultParallelism)  # a task sums up over its shards
    for low, high in _goes(sorted(map(tuple, sets.select("block", "covered").collect())), text_words):
        parts = parts.unionByName(passages.mapInArrow(_long(path, set_path, low, high, shard_words), "query long, data binary"))
    parts = cut(parts)
    held = max(held - bool(own_col), 0)
    sums = parts.groupBy("query").applyInArrow(_scored(held, float(alpha)), "query long, log_prob double, mean_context double, longest_context int")
    out = queries.select("query", "out_id").join(length, "query").join(sums, "query", "left")
    log_prob = F.when(F.col("n_words") > 0, F.coalesce("log_prob", F.lit(0.0)))  # no word anywhere: each is certain
    return out.select(
        F.col("out_id").alias(id_col),
        "n_words",
        F.round(F.coalesce(log_prob, F.lit(0.0)), 6).alias("log_prob"),
        F.round(F.exp(-log_prob / F.col("n_words")), 6).alias("perplexity"),
        F.round(F.when(F.col("n_words") > 0, F.coalesce("mean_context", F.lit(0.0))), 6).alias("mean_context"),
        F.when(F.col("n_words") > 0, F.coalesce("longest_context", F.lit(0))).alias("longest_context"),
    )
