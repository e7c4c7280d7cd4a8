"""Rows of whole numbers packed by key before a shuffle: the rows of a key in a task become one row of compressed columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a task holds before it packs them.
ROWS = 1 << 19
#: Rows of a key, on average, under which numbers are put side by side as they are.
FEW = 8
_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeezed(values: np.ndarray) -> bytes:
    """Differences of each row of ``values``, small ones without sign, the bytes of equal weight together."""
    steps = np.diff(values, axis=1, prepend=0)
    plain = np.ascontiguousarray((steps << 1) ^ (steps >> 63))
    return _ZSTD.compress(plain.view(np.uint8).reshape(*values.shape, 8).transpose(0, 2, 1).tobytes(), asbytes=True)


def _restored(data: bytes, k: int, n: int) -> np.ndarray:
    raw = np.frombuffer(_ZSTD.decompress(data, decompressed_size=8 * k * n, asbytes=True), dtype=np.uint8)
    plain = np.ascontiguousarray(raw.reshape(k, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(k, n)
    return np.cumsum(((plain >> 1) & np.iinfo(np.int64).max) ^ -(plain & 1), axis=1)


def _packed(rows: pa.Table, keys: Sequence[str], values: Sequence[str]) -> pa.RecordBatch:
    plain = lambda c: (c.dictionary_encode().indices if pa.types.is_string(c.type) else c).to_numpy(zero_copy_only=False).astype(np.int64)
    marks = np.stack([plain(rows.column(c).combine_chunks()) for c in keys])
    numbers = np.stack([plain(rows.column(c).combine_chunks()) for c in values])
    order = np.lexsort((*numbers[::-1], *marks[::-1]))
    marks, numbers = marks[:, order], numbers[:, order]
    first = np.flatnonzero(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(axis=0)]))
    ends = np.append(first[1:], len(order))
    if len(order) < FEW * len(first):
        upto = pa.py_buffer((np.append(first, len(order)) * 8 * len(values)).astype(np.int32))
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, upto, pa.py_buffer(np.ascontiguousarray(numbers.T))])
        n = first - ends
    else:
        data = pa.array([_squeezed(numbers[:, i:j]) for i, j in zip(first, ends, strict=True)], pa.binary())
        n = ends - first
    at = pa.array(order[first])
    return pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks().take(at) for c in keys], pa.array(n), data], [*keys, "n", "data"])


def packed(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The keys, n and data: what a task has of ``values`` (whole numbers) for a key, of ``ROWS`` rows at a time. Nothing is null."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS:
                yield _packed(pa.Table.from_batches(held), keys, values)
                held, n = [], 0
        if n:
            yield _packed(pa.Table.from_batches(held), keys, values)

    return rows.select(*keys, *values).mapInArrow(pack, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n long, data binary")


def unpacked(rows: pa.RecordBatch, k: int) -> np.ndarray:
    """The ``k`` values of packed rows, a column for each row that was packed."""
    found = []
    for n, data in zip(rows.column("n").to_pylist(), rows.column("data"), strict=True):
        data = data.as_buffer()
        found.append(_restored(data, k, n) if n > 0 else np.frombuffer(data, dtype=np.int64).reshape(-n, k).T)
    return np.concatenate(found, axis=1)
