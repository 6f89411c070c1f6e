"""What several operators share: the shared folder, materialised tables, files of tasks, and hashed words.

Word hashing works on whole blocks of texts with numpy. Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash

from ..sources.scratch import WRITTEN, discard, materialise, new_path, release, shared_dir  # noqa: F401

#: Texts are hashed in blocks of about so many bytes; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: What a driver-side value may weigh before it is broadcast.
BROADCAST_BYTES = 64 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A filesystem and its path, for files that tasks write or read themselves."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_file(uri: str, parts: Iterable[bytes]) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, *texts: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about limit bytes at most, so that what Python holds at once is bounded."""
    sizes = sum(np.nan_to_num(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.float64)) for k in texts)
    part = (np.cumsum(sizes) // limit).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def blocks(texts: list[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of consecutive blocks of about limit bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def _random_u64(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of its input."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHasher:
    """64-bit hashes of the words of a block, A-Z lower-cased. separators: the bytes that part words, all ASCII.

    A word of up to LONG bytes has the hash sum(code(byte) * P**place), mixed, with random codes; a longer one, for which
    such a sum modulo 2**64 has collisions whatever the codes, the XXH3 of its bytes. Equal words have equal hashes; two
    different ones collide with a chance of about 2**-45 at worst (words of 32 letters made up for it), mostly of 2**-64.
    """

    P, LONG, KEPT = 0x9E3779B97F4A7C15, 32, BLOCK_BYTES + (1 << 18)

    def __init__(self, separators: Iterable[int]):
        code = _random_u64(256, 20)
        code[65:91] = code[97:123]
        self.code, self.apart = code, np.zeros(256, dtype=bool)
        self.apart[list(separators)] = True
        self.powers, self.inverse = self._power(self.P, 1), self._power(pow(self.P, -1, 1 << 64), 1)

    @staticmethod
    def _power(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first word of each text plus the total, starts, ends, start of each text) over the texts joined by a separator."""
        joined = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        n = len(joined)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        if n == 0:
            empty = np.zeros(0, dtype=np.int64)
            return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64), empty, empty, at
        powers, inverse = self.powers, self.inverse
        if n > len(powers):  # those of a usual block are kept, those of a longer text are not
            powers, inverse = (self._power(p, max(n, self.KEPT)) for p in (self.P, pow(self.P, -1, 1 << 64)))
            if n <= self.KEPT:
                self.powers, self.inverse = powers, inverse
        inside = ~self.apart[joined]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        if inside[-1]:
            edge = np.concatenate((edge, [n]))
        starts, ends = edge[0::2], edge[1::2]
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.code[joined] * powers[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts])
        for k in np.flatnonzero(ends - starts > self.LONG).tolist():
            hashes[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]].tobytes().lower())
        return hashes, np.searchsorted(starts, at), starts, ends, at

    def of(self, word: str) -> int:
        return int(self.words([word.encode()])[0][0])
