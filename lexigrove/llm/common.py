"""What the operators share: columns by name, Arrow arrays from numpy's, batches in parts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each lengthened until no column of df has it (without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(df: DataFrame, name: str):
    return df[quoted(name)]


def int_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, named id and text; whatever else docs has doesn't interfere."""
    return docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"))


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary array with a row's bytes for each row of a 2-d array."""
    rows = np.ascontiguousarray(rows)
    if not len(rows):
        return pa.array([], pa.binary())
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def list_array(flat: np.ndarray, lengths: Sequence[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array over flat, with rows of the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def fixed_matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The rows of a binary column without nulls as a matrix with width entries a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), dtype)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), width)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by an integer key column: no group is spread over two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = len(keys) - 1 - int(np.argmax(keys.to_numpy()[::-1] != keys[-1].as_py())) if keys[0] != keys[-1] else -1
        if last >= 0:
            yield pa.Table.from_batches([*held, batch.slice(0, last + 1)])
            held = []
        held.append(batch.slice(last + 1))
    if held:
        yield pa.Table.from_batches(held)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] numbers), then the same from start[1], and so on."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)
