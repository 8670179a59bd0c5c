"""Order and common prefixes of suffixes of a block of texts that a task holds as a whole.

Suffixes are sorted by packed characters first. Those that stay equal for long are parted by pivots: rolling hashes give each one's common prefix with the
pivot of its group by binary search, and that length with the character behind it is the next sort key. No suffix is ever written out, and a
repeat costs the logarithm of its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Characters after which suffixes that are still equal are compared by hashes.
PACKED = 48
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_SALT = np.random.default_rng(90210).integers(0, 1 << 63, 1 << 12, dtype=np.int64).view(_U)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Block:
    """Texts end to end, each with an end behind it.

    code: a number for each character, in their order, from first_code on; an end is 0. special: characters that come before all others, in this order.
    """

    ids: pa.Array
    code: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    kinds: np.ndarray
    special: str = ""
    _hash: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @classmethod
    def of(cls, ids: pa.Array, texts: list[str], special: str = "") -> Block:
        length = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(length + 1) - 1
        flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = np.unique(np.delete(flat, end)) if len(flat) < 1 << 16 else np.flatnonzero(np.bincount(flat, minlength=1))
        first = [ord(c) for c in special]
        order = np.concatenate([np.array(first, np.int64), kinds[~np.isin(kinds, first)].astype(np.int64)])
        table = np.zeros(int(order.max(initial=0)) + 1, np.int32)
        table[order] = np.arange(1, len(order) + 1)
        code = table[flat] if len(flat) else np.zeros(0, np.int32)
        code[end] = 0
        return cls(ids, code, end - length, end, order, special)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at).astype(np.int32)

    @property
    def bits(self) -> int:
        return max(1, int(len(self.kinds)).bit_length())

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the characters' values times powers of a base, and these powers."""
        if self._hash is None:
            n = len(self.code)
            values = _spread(np.arange(len(self.kinds) + 1, dtype=_U) + _SALT[7])
            power = np.full(n + 1, _BASE)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            sums = np.zeros(n + 1, _U)
            np.cumsum(values[self.code] * power[:n], out=sums[1:])
            self._hash = sums, power
        return self._hash

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, least: np.ndarray | int = 0, step: int = 16) -> np.ndarray:
        """Characters that the places a and b have in common, of at most `most`, given that it is at least `least`; step: how many more to try first."""
        sums, power = self.hashes()
        low = np.broadcast_to(np.asarray(least, np.int64), a.shape).copy()
        high = most.astype(np.int64)
        first, last = np.minimum(a, b), np.maximum(a, b)
        lift = power[last - first]
        open_ = np.flatnonzero(low < high)
        # the first steps go up from the least length, doubling; most differ soon
        while len(open_):
            ahead = np.minimum(low[open_] + step, high[open_])
            x, y = first[open_], last[open_]
            same = (sums[x + ahead] - sums[x]) * lift[open_] == sums[y + ahead] - sums[y]
            low[open_[same]] = ahead[same]
            high[open_[~same]] = ahead[~same] - 1
            open_ = open_[same]
            open_ = open_[low[open_] < high[open_]]
            step *= 2
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_] + 1) >> 1
            x, y = first[open_], last[open_]
            same = (sums[x + middle] - sums[x]) * lift[open_] == sums[y + middle] - sums[y]
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def buckets(block: Block, prefixes: list[str], terminator: str | None = None) -> np.ndarray:
    """For each place the number of the prefix that begins there, or -1. No prefix begins another. terminator: in prefixes, stands for a text's end."""
    where = {int(k): i + 1 for i, k in enumerate(block.kinds)}
    if terminator is not None:
        where[ord(terminator)] = 0
    width = len(block.kinds) + 1
    nodes, steps = 1, {}  # of each inner node of the trie and character: the next one, or -2 - prefix
    for number, prefix in enumerate(prefixes):
        path = [where.get(ord(c)) for c in prefix]
        if not path or None in path:
            continue  # a character that no text has
        node = 0
        for c in path[:-1]:
            if node * width + c not in steps:
                steps[node * width + c] = nodes
                nodes += 1
            node = steps[node * width + c]
        steps[node * width + path[-1]] = -2 - number
    edges = np.array(sorted(steps), np.int64)
    to = np.array([steps[k] for k in edges.tolist()], np.int32)
    dense = None
    if nodes * width <= 1 << 22:
        dense = np.full(nodes * width, -1, np.int32)
        dense[edges] = to

    def step(node: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * width + c
        if dense is not None:
            return dense[key]
        at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
        return np.where(edges[at] == key, to[at], np.int32(-1))

    n = len(block.code)
    found = np.full(n, -1, np.int32)
    at = np.arange(n, dtype=np.int64)
    at = at[block.code > 0]
    node, depth = np.zeros(len(at), np.int32), 0
    while len(at) and len(edges):
        node = step(node, block.code[np.minimum(at + depth, n - 1)])
        done = node < -1
        found[at[done]] = -2 - node[done]
        # only the walk into an end can have left the text, and an end goes on nowhere
        on = node > 0
        at, node, depth = at[on], node[on], depth + 1
    return found


def _pack(block: Block, at: np.ndarray, limit: np.ndarray, offset: int, chars: int, bits: int) -> np.ndarray:
    key = np.zeros(len(at), _U)
    for k in range(chars):
        key = (key << _U(bits)) | block.code[np.minimum(at + (offset + k), limit)].astype(_U)
    return key


def _groups(new: np.ndarray) -> np.ndarray:
    """Sizes of the groups, given where each begins, for each member."""
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(new)))
    return np.repeat(size, size)


def suffix_order(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their suffixes, equal ones as they come in the block, and each one's common prefix with the one before (0 for the first)."""
    n = len(at)
    at = np.sort(at)
    if not n:
        return at, np.zeros(0, np.int64)
    limit = block.end[block.doc(at)]
    bits = block.bits
    chars = max(1, 63 // bits)
    key = _pack(block, at, limit, 0, chars, bits)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    depth = chars
    group = np.zeros(n, np.int64)
    tied = np.flatnonzero(_groups(new) > 1)
    group[tied] = np.cumsum(new[tied])
    while len(tied) and depth < PACKED:
        which = order[tied]
        mine = group[tied]
        chars = max(1, (63 - int(mine[-1]).bit_length()) // bits)
        key = (mine.astype(_U) << _U(chars * bits)) | _pack(block, at[which], limit[which], depth, chars, bits)
        by = np.argsort(key)
        order[tied], key = which[by], key[by]
        first = new[tied]  # groups keep their places
        first[1:] |= key[1:] != key[:-1]
        new[tied] = first
        again = _groups(first) > 1
        tied = tied[again]
        if len(tied):
            group[tied] = np.cumsum(first)[again]
        depth += chars
    # deep ties: by the common prefix with a pivot of the group
    while len(tied):
        first = new[tied]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(tied)))
        mine = np.repeat(np.arange(len(begin)), size)
        which = order[tied]
        pivot = which[begin + size // 2][mine]
        a, b = at[which], at[pivot]
        room_a, room_b = limit[which] - a, limit[pivot] - b
        lcp = block.common(a, b, np.minimum(room_a, room_b), np.minimum(np.minimum(room_a, room_b), depth))
        x, y = block.code[a + lcp], block.code[b + lcp]
        same = x == y  # both end here: equal suffixes
        side = np.where(same, 0, np.where(x < y, -1, 1))
        rank = np.where(side < 0, lcp, np.where(side > 0, -lcp, 0))
        by = np.lexsort((at[which], x, rank, side, mine))
        order[tied] = which[by]
        mine, side, rank, x, same = mine[by], side[by], rank[by], x[by], same[by]
        begins = np.ones(len(tied), bool)
        begins[1:] = (mine[1:] != mine[:-1]) | (side[1:] != side[:-1]) | (rank[1:] != rank[:-1]) | (x[1:] != x[:-1])
        new[tied] = begins
        more = (_groups(begins) > 1) & ~same
        tied = tied[more]
    place = at[order]
    room = limit[order] - place
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b, most = place[1:], place[:-1], np.minimum(room[1:], room[:-1])
        # neighbours' packed characters first, hashes for the rest
        low = np.zeros(n - 1, np.int64)
        open_ = np.arange(n - 1)
        for k in range(min(PACKED, 24)):
            on = (k < most[open_]) & (block.code[np.minimum(a[open_] + k, len(block.code) - 1)] == block.code[np.minimum(b[open_] + k, len(block.code) - 1)])
            open_ = open_[on]
            low[open_] = k + 1
        if len(open_):
            low[open_] = block.common(a[open_], b[open_], most[open_], low[open_])
        lcp[1:] = low
    return place, lcp
