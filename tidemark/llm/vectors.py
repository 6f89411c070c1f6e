"""Vectors of an Arrow list column as numpy matrices, and Spark rows in groups that lie together in a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix of doubles) of the vectors of each length that hold finite components only.

    Null and empty vectors, and those that hold null or non-finite components, are left out.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        x = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield size, at[good], x[good]


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """(key, parts) for each run of rows with equal keys; a run may span batches. Read a run's parts before the next run."""
    parts = ((b, a, z) for b in batches for a, z in _edges(b, keys))
    held: list = [next(parts, None)]

    def same(key: tuple) -> Iterator[pa.RecordBatch]:
        while held[0] is not None and _key(held[0], keys) == key:
            b, a, z = held[0]
            yield b.slice(a, z - a)
            held[0] = next(parts, None)

    while held[0] is not None:
        key = _key(held[0], keys)
        yield key, same(key)


def _key(part: tuple[pa.RecordBatch, int, int], keys: tuple[str, ...]) -> tuple:
    return tuple(part[0].column(k)[part[1]].as_py() for k in keys)


def _edges(b: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    if not b.num_rows:
        return
    other = np.zeros(b.num_rows - 1, dtype=bool)
    for k in keys:
        codes = pc.fill_null(b.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        other |= codes[1:] != codes[:-1]
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]
    yield from zip(cuts, cuts[1:], strict=False)
