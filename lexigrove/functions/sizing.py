"""Sizing rules: how many suffixes a prefix may have, how long windows and tails are, how many workers help."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

BYTES_PER_SUFFIX = 20
LEAST_LIMIT, USER_LEAST = 50_000, 100


def frequency_limit(file_size: int, free_bytes: float, total_bytes: float, executors: int) -> int:
    """Suffixes that a prefix may have, so that 40 % of an executor's share of memory holds them; grows with the input from 50,000 on."""
    if file_size <= 0:
        return 2048
    usable = min(free_bytes, total_bytes * 0.7) / max(1, executors) * 0.4
    return min(int(usable // BYTES_PER_SUFFIX), max(LEAST_LIMIT, file_size // 50))


def longest_prefix(length: int, limit: int, alphabet: int = 256) -> int:
    """Prefix length at which an even text of that length would have at most limit suffixes per prefix."""
    if limit <= 0 or length <= limit:
        return 1
    return math.ceil(math.log(length / limit, alphabet))


def helpful_workers(file_size: int, limit: int) -> int:
    return min(8, max(2, math.ceil(2 * file_size / limit)))


def fits(file_size: int, limit: int) -> bool:
    return file_size <= limit


@dataclass
class IndexConfig:
    """Options of a build. A limit given by the user is at least 100; None or 0 takes the rule's.

    boundary: "document" (texts end apart) or "superstring" (texts joined by one separator, with one terminator).
    complete: suffixes too short for a window get buckets of their own, so that none is left out.
    max_positions: keep only so many of a prefix's first suffixes (None: all).
    """

    memory_limit: int | None = None
    num_workers: int = 4
    window: int = 1
    step: int = 1
    max_window: int = 100
    tail_length: int | None = None
    alphabet: int = 256
    exclude_newlines: bool = True
    boundary: str = "document"
    complete: bool = False
    max_positions: int | None = None
    free_bytes: float = field(default=8e9)
    total_bytes: float = field(default=16e9)

    @classmethod
    def from_options(cls, options: dict[str, str | int | None]) -> IndexConfig:
        """From options as a form sends them (numWorkers, memoryLimit, tailLength): the whole number that a value begins with; the default where there is none, or 0."""

        def number(name: str) -> int | None:
            found = re.match(r"\s*[+-]?\d+", str(options.get(name) or ""))
            return int(found.group()) or None if found else None

        return cls(num_workers=number("numWorkers") or 4, memory_limit=number("memoryLimit"), tail_length=number("tailLength"))

    def __post_init__(self) -> None:
        if self.boundary not in ("document", "superstring"):
            raise ValueError(f"no such boundary: {self.boundary}")
        self.num_workers = max(1, self.num_workers)

    def resolved_limit(self, file_size: int) -> int:
        if self.memory_limit:
            return max(USER_LEAST, self.memory_limit)
        return frequency_limit(file_size, self.free_bytes, self.total_bytes, self.num_workers)

    def resolved_tail(self, file_size: int) -> int:
        if self.tail_length:
            return self.tail_length
        return max(self.window, longest_prefix(file_size, self.resolved_limit(file_size), self.alphabet) if file_size > 0 else 1)
