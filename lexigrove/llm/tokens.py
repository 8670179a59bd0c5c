"""Token counts of the sections of a document, from one encoding of the whole document.

The byte-level tokenizer's tokens, end to end, are the text, so their lengths give each token's span. Spans of tokens
and sections are ascending, so their interval join is one merge of sorted bounds. A token over a boundary goes where RULE says.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..arrow import slices
from . import words
from .common import int_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging.
PATTERN = "|".join([r"'s", r"'t", r"'re", r"'ve", r"'m", r"'ll", r"'d", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"])
#: first: the section of the token's first character; last: of its last; majority: the one with most of its characters, the earlier if some tie.
RULES = ("first", "last", "majority")
#: Runs of white space so long that the pattern's look-ahead would exhaust its stack; what the pattern takes for white space, as a class of code points.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a rank file, and the bytes that each token stands for, as lengths."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode_text(coder, text: str) -> np.ndarray:
    """The ids of a text of any length.

    A long run of white space is taken out of the pattern's hands: it is one piece, but for its last character, which goes with what follows, unless
    the text ends there. That is how the pattern splits, so the ids are the same.
    """
    out, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            out.append(coder.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        out.append(np.array(coder._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
        at = end
    if at < len(text):
        out.append(coder.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For tokens [start, end), the section of each and whether it crosses a boundary.

    Section i is [bounds[i], bounds[i + 1]); tokens and sections cover the same range and none is empty. lead: for every
    unit of the range, whether a character begins there; the majority is of these.
    """
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    if rule != "majority":
        raise ValueError(f"no such rule: {rule}")
    out = first.copy()
    for i in np.flatnonzero(crossing):
        parts = range(int(first[i]), int(last[i]) + 1)
        spans = [(max(int(start[i]), int(bounds[s])), min(int(end[i]), int(bounds[s + 1]))) for s in parts]
        size = [b - a if lead is None else int(lead[a:b].sum()) for a, b in spans]
        out[i] = first[i] + int(np.argmax(size))
    return out, crossing


def _count(path: str, rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = encoding(path)
        for batch in batches:
            for part in slices(batch, 1):
                raw, offsets = words.text_buffer(part.column(1))
                lead = (raw & 0xC0) != 0x80
                char = np.concatenate([[0], np.cumsum(lead)])
                ids = [encode_text(coder, x or "") for x in part.column(1).to_pylist()]
                size = lengths[np.concatenate(ids)] if ids else np.zeros(0, np.int64)
                end = np.cumsum(size)
                if len(raw) != (end[-1] if len(end) else 0):
                    raise ValueError("the tokens aren't the text")
                # all texts of the batch lie end to end; a section ends behind a newline and at the end of its text
                bounds = np.union1d(np.flatnonzero(raw == 10) + 1, offsets)
                where, crossing = attribute(end - size, end, bounds, rule, lead)
                n = len(bounds) - 1
                row = np.searchsorted(offsets, bounds[:-1], "right") - 1
                begin = char[bounds]
                first = np.searchsorted(bounds, offsets[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)),
                        pa.array((np.arange(n) - first[row]).astype(np.int32)),
                        pa.array((begin[:-1] - char[offsets[row]]).astype(np.int32)),
                        pa.array((begin[1:] - char[offsets[row]]).astype(np.int32)),
                        pa.array(np.bincount(where, minlength=n)[:n]),
                        pa.array(np.bincount(where, weights=crossing, minlength=n)[:n].astype(np.int64)),
                    ],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
                )

    return count


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing) for each section of each text.

    A section is a line with its newline. Its tokens are those that rule gives it, of the encoding of the whole text, so the sections' counts add up to the
    text's; n_crossing of them reach into another section. Null and empty texts have no sections. Rows are counted each by itself, so repeated
    ids have their sections several times and a null id stays null. A text may be of any length, white space of any length included. Names of special tokens in a text are ordinary text. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    plain = int_text(docs, id_col, text_col).where("text is not null")
    return plain.mapInArrow(_count(vocabulary, rule), "doc_id long, section int, start_char int, end_char int, n_tokens long, n_crossing long")
