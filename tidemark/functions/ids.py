"""Identities that are kept across runs, so they never change: FNV-1a, the splitmix finalizer, and behavior ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1


def fnv1a64(data: bytes, start: int = 0xCBF29CE484222325) -> int:
    h = start
    for b in data:
        h = (h ^ b) * 0x100000001B3 & MASK
    return h


def mix64(x: int) -> int:
    """The 64-bit finalizer of MurmurHash3."""
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & MASK
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def behavior_id(kind: str, template: str) -> str:
    """Sixteen hex digits that name a behavior: a hash of its kind and template."""
    return f"{mix64(fnv1a64(kind.encode() + b'\x1f' + template.encode())):016x}"


def fnv1a64_all(values: pa.Array, start: int = 0xCBF29CE484222325) -> np.ndarray:
    """fnv1a64 of each string, as uint64: a step for each place over all strings that are so long, longest first.

    Where few strings are left, they go on one by one. A null has the hash of an empty string.
    """
    values = values.cast(pa.large_binary())
    n, offset = len(values), values.offset
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[offset : offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    sizes = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    order = np.argsort(-sizes, kind="stable")
    at, left, h = ends[:-1][order], sizes[order], np.full(n, start, dtype=np.uint64)
    live, place = int((left > 0).sum()), 0
    while live > 16:
        h[:live] = (h[:live] ^ data[at[:live] + place]) * np.uint64(0x100000001B3)
        place += 1
        while live and left[live - 1] <= place:
            live -= 1
    for k in range(live):
        h[k] = fnv1a64(data[at[k] + place : at[k] + left[k]].tobytes(), int(h[k]))
    out = np.empty_like(h)
    out[order] = h
    return out


def mix64_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


@F.arrow_udf(T.StringType())
def behavior_ids(kind: pa.Array, template: pa.Array) -> pa.Array:
    """behavior_id of each row; null where either is."""
    out, known = np.full(len(kind), None, dtype=object), pc.and_(pc.is_valid(kind), pc.is_valid(template))
    for k in pc.unique(kind.filter(known)).to_pylist():
        at = np.flatnonzero(pc.fill_null(pc.and_(known, pc.equal(kind, k)), False).to_numpy(zero_copy_only=False))
        digits = mix64_all(fnv1a64_all(template.take(pa.array(at)), fnv1a64(k.encode() + b"\x1f"))).astype(">u8").tobytes().hex()
        out[at] = [digits[i : i + 16] for i in range(0, len(digits), 16)]
    return pa.array(out, pa.string())
