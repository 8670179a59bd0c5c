"""Vectorised word scanning and rolling hashes over Arrow string buffers.

A *word* is a maximal run of bytes that are not ASCII white space. All arithmetic is
modulo 2**64 in numpy, so a batch of texts costs a few passes over its bytes and never
a Python-level loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 21
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def _odd_constant(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) * 2 + 1


_BYTE_CODES = np.random.default_rng(20177).integers(0, 1 << 63, 256, dtype=np.int64).view(_U) * _U(2) + _U(1)
_BYTE_BASE = _odd_constant(411)
_GRAM_BASE = _odd_constant(977)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls and grown by doubling."""
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        for k, b in ((0, base), (1, pow(base, -1, 1 << 64))):
            steps = np.full(size, b & ((1 << 64) - 1), dtype=_U)
            steps[0] = 1
            _powers[base, k] = np.multiply.accumulate(steps)
    return _powers[base, 0], _powers[base, 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the entropy of every bit over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len+1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte spans in the flat buffer, the batch row each belongs to, 64-bit hashes."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # per row: index of its first word; len(rows) + 1 entries
    code: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and per row the index of its first word."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[cuts] = solid[cuts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[cuts - 1] = solid[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets, "left")


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span; spans are ascending and disjoint."""
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        power, inverse = _power_table(_BYTE_BASE, b - a)
        sums = np.zeros(b - a + 1, _U)
        np.cumsum(_BYTE_CODES[raw[a:b]] * power[: b - a], out=sums[1:])
        out[i:j] = mix((sums[end[i:j] - a] - sums[start[i:j] - a]) * inverse[start[i:j] - a] + (end[i:j] - start[i:j]).astype(_U))
        i = j
    return out


def scan(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    raw, offsets = text_buffer(column)
    start, end, first = word_spans(raw, offsets)
    return raw, offsets, Words(start, end, first, hash_spans(raw, start, end))


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive codes, len(code) - n + 1 of them (none if there are fewer codes)."""
    m = len(code) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.empty(m, _U)
    step = 1 << 18
    for a in range(0, m, step):
        b = min(m, a + step)
        part = code[a : b + n - 1]
        power, inverse = _power_table(_GRAM_BASE, len(part))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out[a:b] = mix((sums[n:] - sums[:-n]) * inverse[: b - a])
    return out


def whole(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the n-gram at each of the total - n + 1 places lies within one row."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    return ok
