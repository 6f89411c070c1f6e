"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors are scaled to length one, so a cosine of at least c means a distance of at most sqrt(2 - 2c). A hash is k
projections on normal directions, each shifted and cut into steps of a width; each of several tables has a hash of its
own, and vectors of one label that share a hash in a table are compared. With 12 projections of width 1.4 and 48
tables, two vectors at exactly cosine 0.98 (distance 0.2) meet in a table with probability 0.886**12 = 0.234, so in none with
0.766**48 = 0.000003; nearer pairs are missed less often.

Equal vectors of a label become one first, with a multiplicity. Buckets are found by their numbers alone; those of one
and the same set of vectors count once, in the first table, and only then are vectors sent to buckets. A bucket is cut
into blocks of at most BLOCK vectors by a hash, and each pair of blocks is a group of its own, so no group is larger
than two blocks; links are counted by numpy, not emitted as pairs. A pair is counted in the first table in which both
vectors meet: a task hashes its vectors again, by sums of whole numbers, which give the same in any order.

Cases: a null label, and a vector that is null, empty, zero, or holds null or non-finite components, links with
nothing; vectors of other lengths than each other never link; equal rows link; rows that repeat a vec_id are counted
as vectors each and share a component, also where their vectors differ; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, discard, materialise
from .components import components

TABLES, PROJECTIONS, WIDTH = 48, 12, 1.4
BLOCK = 1_024
#: Unit vectors and directions are rounded to multiples of these, so that projections are whole numbers, summed exactly.
UNIT, NORMAL = 2.0**-20, 2.0**-12


@lru_cache(8)
def _directions(dim: int, tables: int, projections: int, width: float, seed: int = 7):
    rng = np.random.default_rng([seed, dim])
    normal = np.rint(rng.standard_normal((dim, tables * projections)) / NORMAL)
    shift = np.rint(rng.uniform(0, width, tables * projections) / (UNIT * NORMAL))
    return normal, shift, rng.integers(0, 1 << 63, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """The hash of each row in each table, as uint64 [rows, tables]; equal for equal rows, whatever others are beside."""
    normal, shift, odd = _directions(unit.shape[1], tables, projections, width)
    steps = np.floor((np.rint(unit / UNIT) @ normal + shift) / (width / (UNIT * NORMAL)))
    steps = steps.astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    x = (steps * odd).sum(2, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _numbered(vectors: DataFrame, kind: str, tables: int, projections: int, width: float) -> DataFrame:
    """row, vec_id, key, label, dim, data, buckets of each vector; key is null for one that links with nothing.

    row numbers the rows; key stands for label and vector; data holds the components; a bucket's last bits are its table.
    """
    bits = max(1, (tables - 1).bit_length())
    low = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            n, labels = b.num_rows, b.column(2).to_pylist()
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            keys, dims, data, buckets = [None] * n, [None] * n, [None] * n, [None] * n
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                x = pc.list_flatten(b.column(1).take(pa.array(at))).to_numpy(zero_copy_only=False).reshape(-1, size) + 0.0  # -0.0 is 0.0
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) & np.array([labels[i] is not None for i in at])
                at, x = at[good], x[good]
                if len(at):
                    raw = x.astype(kind)
                    h = hashes(_units(raw), tables, projections, width)
                    of = np.array([xxhash.xxh3_64_intdigest(f"{size}:{labels[i]}") for i in at], dtype=np.uint64)
                    h = ((h ^ of[:, None]) * np.uint64(0x9E3779B97F4A7C15) & ~low | np.arange(tables, dtype=np.uint64)).view(np.int64)
                    for i, values, places in zip(at.tolist(), raw, h, strict=True):
                        data[i], dims[i], buckets[i] = values.tobytes(), size, places
                        keys[i] = hashlib.blake2b(labels[i].encode() + b"\x00" + data[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), b.column(0), pa.array(keys, pa.binary()), b.column(2), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["row", "vec_id", "key", "label", "dim", "data", "buckets"],
            )
            row += n

    return materialise(vectors.mapInArrow(run, "row long, vec_id long, key binary, label string, dim int, data binary, buckets array<long>"), "vectors")


def _counted(cells: DataFrame, kind: str, cosine: float, tables: int, projections: int, width: float) -> DataFrame:
    """row, rep, n, to of those of cells that have a link: n, the links first met in their bucket; to, the least rep linked with.

    cells: bucket, i, j (the blocks that meet), part (the row's own), row, rep, times, label, dim, data; sorted by the
    first three, all of a group in one partition. A batch holds many groups.
    """
    low = (1 << max(1, (tables - 1).bit_length())) - 1
    out_schema = pa.schema([("row", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def group(b: pa.RecordBatch, t: int, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        x = _units(np.frombuffer(b"".join(b.column("data").to_pylist()), dtype=kind).reshape(b.num_rows, -1))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if apart:
            part = b.column("part").to_numpy()
            near &= part[:, None] != part[None, :]
        rep, times = b.column("rep").to_numpy(), b.column("times").to_numpy()
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), dtype=np.int64)
        place[order] = np.arange(len(rep))
        label = place  # the least place that each reaches here
        one, two = np.nonzero(near)
        while len(one):
            least = label.copy()
            np.minimum.at(least, one, label[two])
            least = np.minimum(least, least[order[least]])
            if (least == label).all():
                break
            label = least
        counted = np.zeros(len(rep), dtype=np.int64)
        if len(one) and t:
            h = hashes(x, tables, projections, width)[:, :t]
            for k in range(0, len(one), 1 << 16):
                a, z = one[k : k + (1 << 16)], two[k : k + (1 << 16)]
                first = ~(h[a] == h[z]).any(axis=1)
                np.add.at(counted, a[first], times[z[first]])
        else:
            np.add.at(counted, one, times[two])
        return counted, rep[order[label]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def judged(table: pa.RecordBatch) -> pa.RecordBatch:
            ids = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            n, to = np.zeros(len(ids), dtype=np.int64), table.column("rep").to_numpy().copy()
            labels, dims = table.column("label").to_pylist(), table.column("dim").to_numpy()
            for a, z in zip(edges, edges[1:], strict=False):
                # a bucket's number is a hash, so other labels or lengths may share it
                kinds = {(labels[k], dims[k]) for k in range(a, z)}
                for one in kinds:
                    at = np.arange(a, z) if len(kinds) == 1 else np.array([k for k in range(a, z) if (labels[k], dims[k]) == one])
                    if len(at) > 1:
                        part = table.slice(a, z - a) if len(kinds) == 1 else table.take(pa.array(at))
                        n[at], to[at] = group(part, int(ids[a, 0]) & low, ids[a, 1] != ids[a, 2])
            linked = pa.array(np.flatnonzero((n > 0) | (to != table.column("rep").to_numpy())))
            return pa.RecordBatch.from_arrays([table.column("row").take(linked), table.column("rep").take(linked), pa.array(n).take(linked), pa.array(to).take(linked)], schema=out_schema)

        for b in batches:
            # the last group of a batch may go on in the next
            ids = [b.column(c).to_numpy() for c in ("bucket", "i", "j")]
            other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))
            cut = int(other[-1]) + 1 if len(other) else 0
            goes_on = held and all(held[0].column(c)[0].as_py() == x[0] for c, x in zip(("bucket", "i", "j"), ids, strict=True))
            if held and (cut or not goes_on):
                done = [*held, b.slice(0, cut)] if cut else held
                yield judged(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
                held = []
            elif cut:
                yield judged(b.slice(0, cut))
            held.append(b.slice(cut))
        if held:
            yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return cells.mapInArrow(run, "row long, rep long, n long, to long")


def _small(rows: DataFrame, n: int, bytes_each: int) -> DataFrame:
    """rows, for all tasks if so many are known to be few."""
    return F.broadcast(rows) if n * bytes_each <= BROADCAST_BYTES else rows


def links(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """A row for each of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    known = _numbered(v, kind, tables, projections, width)
    sound = known.where("key is not null")
    # equal vectors are one, named by the smallest id
    reps = materialise(sound.groupBy("key").agg(F.min("row").alias("row"), F.min("vec_id").alias("rep"), F.count("*").alias("times")), "distinct-vectors")
    n_reps = reps.count()
    if n_reps == sound.count():
        chosen = sound
        held = sound.select("row", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("times"), "label", "dim", "data")
    else:
        chosen = sound.join(reps.select("row"), "row", "left_semi")
        held = sound.join(reps.select("row", "rep", "times"), "row").select("row", "rep", "times", "label", "dim", "data")
    spots = chosen.select("row", F.explode("buckets").alias("bucket"))
    many = materialise(spots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared-buckets")
    hits = materialise(spots.join(_small(many, many.count(), 16), "bucket"), "bucket-rows")
    bits = max(1, (tables - 1).bit_length())
    # buckets of the same rows: the one of the first table stands for all, since pairs are counted where they first meet
    sets = hits.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    table = F.col("bucket").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    first = sets.groupBy("n", "x", "y").agg(F.min(F.struct(table.alias("t"), "bucket")).alias("s"))
    first = materialise(first.select("s.bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "buckets")
    placed = hits.join(_small(first, first.count(), 24), "bucket").withColumn("part", F.pmod(F.xxhash64("row", "bucket"), "parts").cast("int"))
    # block i meets every block j >= i; a row goes to each pair of blocks that has its own
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("row", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")
    cells = cells.join(held, "row").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = materialise(_counted(cells, kind, cosine, tables, projections, width), "links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("rep").alias("a"), F.col("to").alias("b"))
    # a vec_id of several vectors is one node
    short = F.xxhash64("key")
    several = sound.groupBy("vec_id").agg(F.min(short).alias("x"), F.max(short).alias("y")).where("x <> y").select("vec_id")
    edges = edges.union(sound.select("vec_id", "key").join(several, "vec_id").join(reps.select("key", "rep"), "key").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    labels = components(edges)
    by_key = reps.select("row", "key", "rep", "times").join(counts, "row", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    by_key = by_key.select("key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component"))
    discard(many, hits, first)
    out = known.select("vec_id", "key").join(by_key, "key", "left")
    # a row that links with nothing is where others of its vec_id are, if any
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
