"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is cut into words that bear the mark of the space before them. The distinct new words of a batch, sorted, are a trie; one
depth-first walk keeps the forward states of the current prefix, and a word goes on from the states it shares with the word before.
For a unigram model a state is the best score of a prefix and its last piece. For a BPE model it is the one last piece that the merges leave:
a segmentation is what BPE makes of a prefix if and only if each pair of neighbours in it stays unmerged, so the states follow
from shorter prefixes just as the scores do. Words that were met before, in this worker, are looked up by their hash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..arrow import slices
from . import words
from .common import col, int_text, list_array, ranges

_U = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 3_000_000
_FIRST = _U(0xA24BAED4963EE407)


class PieceModel:
    """Pieces of a model file, and the segmentation of single marked words."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rule, trainer = proto.normalizer_spec, proto.trainer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is are supported")
        if trainer.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.dummy_prefix = rule.add_dummy_prefix
        self.unigram = trainer.model_type == 1
        self.names = [p.piece for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.fallback = trainer.byte_fallback
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined symbols aren't supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.ids = {s: i for s, (i, _) in normal.items()}
        self.score = {s: x for s, (_, x) in normal.items()}
        self.longest = max((len(s) for s in normal), default=1)
        inner = {c for s in normal if len(s) > 1 for c in s}
        #: White space that no longer piece has: always a word by itself.
        self.alone = [b for b in (9, 10, 13) if chr(b) not in inner]
        if any(MARK in s.lstrip(MARK) for s in normal):
            raise ValueError("a piece goes over the boundary of words")
        self.lowest = min((x for _, x in normal.values()), default=0.0) - 10.0
        data = [bytes([self.bytes.index(i)]) if p.type == 6 else b"" if p.type == 3 else (" ⁇ " if p.type == 2 else p.piece.replace(MARK, " ")).encode() for i, p in enumerate(proto.pieces)]
        self.piece_length = np.array([len(x) for x in data], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(data), np.uint8)
        if not self.unigram:
            self._order_merges()

    # BPE: rank of a symbol in the order of merges (characters first), the symbols that its last merge joined

    def _order_merges(self) -> None:
        merged = sorted((s for s in self.ids if len(s) > 1), key=lambda s: (-self.score[s], s))
        characters = sorted({c for s in self.ids for c in s})
        self.rank = {s: i for i, s in enumerate(characters)}
        self.rank |= {s: len(characters) + i for i, s in enumerate(merged)}
        self.parts = {c: (c, c) for c in characters}
        for s in merged:
            if (last := self._last_merge(s)) is not None:
                self.parts[s] = last
        self.stays: dict[tuple[str, str], bool] = {}

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What BPE makes of text, best score first and leftmost among equals; and the last pair that it joined."""
        symbols: list[str | None] = list(text)
        n, last = len(symbols), None
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score = self.score
        open_: list[tuple[float, int, str]] = []  # (score less than 0 first, place, what the pair there makes)

        def offer(i: int) -> None:
            if i >= 0 and right[i] < n:
                joint = symbols[i] + symbols[right[i]]
                x = score.get(joint)
                if x is not None:
                    heapq.heappush(open_, (-x, i, joint))

        for i in range(n - 1):
            offer(i)
        while open_:
            _, i, joint = heapq.heappop(open_)
            j = right[i] if symbols[i] is not None else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != len(joint) or symbols[i] + symbols[j] != joint:
                continue  # one of the two has been merged since
            last = symbols[i], symbols[j]
            symbols[i], symbols[j] = joint, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbols if s is not None], last

    def _last_merge(self, s: str) -> tuple[str, str] | None:
        symbols, last = self.merges(s)
        return last if symbols == [s] else None

    def _unmerged(self, a: str, b: str) -> bool:
        """Whether BPE leaves the pieces a and b, side by side, as they are: undoes their merges, latest first, and looks for an earlier one over the boundary."""
        rank, parts = self.rank, self.parts
        limit = math.inf
        while True:
            joint = rank.get(a + b)
            if joint is not None and joint < limit:
                return False
            x, y = rank.get(a, -1), rank.get(b, -1)
            if x > y and len(a) > 1:
                limit, a = x, parts[a][1]
            elif len(b) > 1:
                limit, b = y + 1, parts[b][0]
            elif len(a) > 1:
                limit, a = x, parts[a][1]
            else:
                return True

    def segment(self, ordered: list[str]) -> Iterator[list[str]]:
        """The pieces of each of sorted words."""
        walk = self._walk_unigram if self.unigram else self._walk_merges
        return walk(ordered)

    def _walk_merges(self, ordered: list[str]) -> Iterator[list[str]]:
        parts, stays, longest = self.parts, self.stays, self.longest
        before, last = "", [""]  # last[i]: the last piece of the first i characters
        for word in ordered:
            if MARK + MARK in word:  # pieces of marks alone have equal scores, so their order is by place
                yield self.merges(word)[0]
                continue
            i, n = 0, len(word)
            most = min(len(before), n)
            while i < most and before[i] == word[i]:
                i += 1
            del last[i + 1 :]
            before = word
            for end in range(i + 1, n + 1):
                piece = word[end - 1]
                for begin in range(max(0, end - longest), end):
                    candidate = word[begin:end]
                    if candidate in parts:
                        if begin == 0:
                            piece = candidate
                            break
                        pair = (last[begin], candidate)
                        ok = stays.get(pair)
                        if ok is None:
                            ok = stays[pair] = self._unmerged(*pair)
                        if ok:
                            piece = candidate
                            break
                last.append(piece)
            out, end = [], n
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1]
            if len(stays) > 4_000_000:
                stays.clear()

    def _walk_unigram(self, ordered: list[str]) -> Iterator[list[str]]:
        score, longest = self.score, self.longest
        before, best, last = "", [0.0], [""]
        for word in ordered:
            i, n = 0, len(word)
            most = min(len(before), n)
            while i < most and before[i] == word[i]:
                i += 1
            del best[i + 1 :], last[i + 1 :]
            before = word
            for end in range(i + 1, n + 1):
                top, piece = -math.inf, ""
                for begin in range(max(0, end - longest), end):
                    candidate = word[begin:end]
                    x = score.get(candidate)
                    if x is None:
                        if end - begin > 1:
                            continue
                        x = self.lowest
                    if best[begin] + x > top:
                        top, piece = best[begin] + x, candidate
                best.append(top)
                last.append(piece)
            out, end = [], n
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1]

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        unknown = False
        for s in pieces:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in s.encode()]
            elif not unknown:
                out.append(self.unknown)
            unknown = i is None
        return out


class _Memory:
    """Hashes of words and their ids: two sorted segments, so that new words don't move all old ones each time."""

    def __init__(self) -> None:
        empty = np.zeros(0, np.int64)
        self.segments = [(empty.view(_U), empty, empty)] * 2
        self.ids = [np.zeros(0, np.int32)]
        self.used = 0

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start (-1: not there) and number of ids for each hash."""
        start, size = np.full(len(code), -1), np.zeros(len(code), np.int64)
        for codes, starts, sizes in self.segments:
            if len(codes):
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
        return start, size

    def add(self, code: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.used + np.cumsum(sizes) - sizes
        self.ids.append(np.array([i for x in ids for i in x], np.int32))
        self.used += int(sizes.sum())
        self.segments[1] = self._merged(self.segments[1], (code, starts, sizes))
        if len(self.segments[1][0]) * 4 > len(self.segments[0][0]):
            self.segments = [self._merged(*self.segments), (code[:0], starts[:0], sizes[:0])]

    @staticmethod
    def _merged(a, b):
        columns = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(x[order] for x in columns)

    def flat(self) -> np.ndarray:
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        return self.ids[0]

    def __len__(self) -> int:
        return sum(len(s[0]) for s in self.segments)


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[PieceModel, list[_Memory]]:
    return PieceModel(path), [_Memory()]


def marked_words(raw: np.ndarray, offsets: np.ndarray, alone: list[int]) -> np.ndarray:
    """Starts of words: each text's first byte, a space behind anything but a space or mark, and white space that stands alone, with what follows it."""
    begins = np.zeros(len(raw), bool)
    if not len(raw):
        return np.zeros(0, np.int64)
    space = raw == 32
    begins[1:] = space[1:] & ~space[:-1]
    mark = np.frombuffer(MARK.encode(), np.uint8)
    after = np.flatnonzero((raw[:-3] == mark[0]) & (raw[1:-2] == mark[1]) & (raw[2:-1] == mark[2])) + 3 if len(raw) > 3 else []
    begins[after] = False
    single = np.isin(raw, alone)
    begins |= single
    begins[1:] |= single[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


def encode_batch(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts end to end, and how many each text has. A null counts as an empty text."""
    model, memories = _loaded(path)
    if len(memories[0]) > REMEMBERED:
        memories[0] = _Memory()
    memory = memories[0]
    raw, offsets = words.text_buffer(column)
    start = marked_words(raw, offsets, model.alone)
    end = np.append(start[1:], len(raw))[: len(start)]
    first = np.searchsorted(start, offsets)
    code = words.hash_spans(raw, start, end)
    if model.dummy_prefix:
        code[first[:-1][np.diff(offsets) > 0]] ^= _FIRST  # these have one mark more
    kinds, at, inverse = np.unique(code, return_index=True, return_inverse=True)
    begin, size = memory.find(kinds)
    new = np.flatnonzero(begin < 0)
    if len(new):
        leads = np.zeros(len(start), bool)
        leads[first[:-1][np.diff(offsets) > 0]] = model.dummy_prefix
        data = raw.tobytes()
        texts = [(MARK if leads[i] else "") + data[start[i] : end[i]].decode().replace(" ", MARK) for i in at[new]]
        order = sorted(range(len(new)), key=texts.__getitem__)
        memory.add(kinds[new[order]], [model.piece_ids(x) for x in model.segment([texts[i] for i in order])])
        begin, size = memory.find(kinds)
    begin, size = begin[inverse], size[inverse]
    total = np.concatenate([[0], np.cumsum(size)])
    return memory.flat()[ranges(begin, size)], total[first[1:]] - total[first[:-1]]


def decode_batch(ids: np.ndarray, count: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and how many each text has; count: the ids of each text."""
    model, _ = _loaded(path)
    size = model.piece_length[ids]
    data = model.piece_bytes[ranges(model.piece_start[ids], size)]
    ends = np.concatenate([[0], np.cumsum(count)])
    total = np.concatenate([[0], np.cumsum(size)])[ends]
    length = np.diff(total)
    if model.dummy_prefix:
        lead = total[:-1][length > 0]
        drop = lead[data[lead] == 32]
        data = np.delete(data, drop)
        length = length - np.bincount(np.searchsorted(total, drop, "right") - 1, minlength=len(length))[: len(length)]
    return data, length


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                texts = part.column(1)
                ids, count = encode_batch(texts, path)
                data, length = decode_batch(ids, count, path)
                raw, offsets = words.text_buffer(texts)
                same = length == np.diff(offsets)
                if same.all():
                    differ = np.concatenate([[0], np.cumsum(data != raw)])[offsets]
                    same = np.diff(differ) == 0
                else:
                    ends = np.concatenate([[0], np.cumsum(length)])
                    same = np.array([data[ends[i] : ends[i + 1]].tobytes() == raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)])
                there = texts.is_valid()
                nulls = ~there.to_numpy(zero_copy_only=False)
                lists = list_array(ids, count, pa.int32())
                if nulls.any():
                    lists = lists.filter(there).take(pa.array(np.cumsum(~nulls) - 1, mask=nulls))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int32), mask=nulls), pa.array(same, mask=nulls), lists], ["doc_id", "n_tokens", "round_trip", "ids"])

    return encode


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, round_trip, ids) of each row: the ids of its text, and whether decoding them gives the text again.

    The empty text has no ids; of a null text all but the id is null. Each row is encoded by itself, so repeated rows agree and null ids stay. round_trip
    is false, in texts of any length, only for one with the mark U+2581 itself, which decodes to a space, or with characters unknown to a model without byte pieces. An empty table gives no rows.
    """
    return int_text(docs, id_col, text_col).mapInArrow(_encode(model), "doc_id long, n_tokens int, round_trip boolean, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from ids. A null list gives a null text, an empty one the empty text; null ids in a list are left out; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = [None if x is None else [i for i in x if i is not None] for x in lists.to_pylist()]
            count = np.array([len(x or []) for x in rows], np.int64)
            data, length = decode_batch(np.array([i for x in rows for i in x or []], np.int64), count, model)
            ends = np.concatenate([[0], np.cumsum(length)])
            texts = [None if x is None else data[ends[i] : ends[i + 1]].tobytes().decode(errors="replace") for i, x in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(col(encoded, id_col).cast("long").alias("doc_id"), col(encoded, ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
