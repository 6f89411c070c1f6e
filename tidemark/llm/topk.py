"""Exact top-k by inner product, from an impact-ordered index that is read score at a time.

Vectors become whole numbers, floor(scale * component). The index has shards of about SHARD_CELLS components. In a shard,
the values of each dimension are quantised to at most LEVELS levels, and the vectors of one level of one dimension are a
posting segment. A query gives each segment an impact, its component times the level's edge that makes the product
largest. Segments are processed by descending impact and added up, so that at any time

    sum of the impacts seen + (dimensions not seen) * (largest impact not processed)

is no less than a vector's score. Each vector that may still reach the k-th best score known of the query is a possible
member. A query stops only when all others are proven to be none and the possible members are few, or when all segments
are processed; the possible members are then scored exactly from the shard's stored vectors.

Shards are files in the shared folder, written by tasks; a table names those of tasks that ended. Queries meet them in
waves, each of as many shards as all waves before it had times GROWTH: the k-th best score of earlier shards is the
bound that later ones start with. Queries are split over tasks by a hash, so a shard is read by several tasks and one
task scores a bounded share of the queries.

Cases: a vector that is null or empty, holds null or non-finite components, or whose squared largest value times its
length is above 2**50 (a score might not be exact) takes no part; vectors meet those of their own length only; a query
is not its own candidate, but another row with the same vec_id is; a row without vec_id is a candidate, after all others
of its score, and no query; rows that repeat a vec_id are queries each; ties go to the smaller vec_id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, discard, materialise, new_path, read_file, write_file
from .vectors import by_length, runs

#: Components of a shard, and the most vectors that it may have on average (places in a shard are 16-bit numbers).
SHARD_CELLS, SHARD_MOST = 1 << 20, 1 << 14
LEVELS = 64
#: Queries that meet a shard in one task, at most.
QUERIES = 8_192
#: Each wave has so many times the shards of all before it.
GROWTH = 3
#: Shares of a shard's postings after which possible members are counted.
CHECKS = (0.35, 0.5, 0.65, 0.8, 1.0)


def numbered(vectors: DataFrame, scale: int) -> DataFrame:
    """row, vec_id, dim, data (64-bit whole numbers) of each vector that takes part; row numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for size, at, x in by_length(b.column(1)):
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                    good = np.abs(x).max(axis=1) <= (2.0**50 / size) ** 0.5
                at, data = at[good], x[good].astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + at), b.column(0).take(pa.array(at)), pa.array(np.full(len(at), size, dtype=np.int32)), pa.array([v.tobytes() for v in data], pa.binary())],
                    names=["row", "vec_id", "dim", "data"],
                )
            row += b.num_rows

    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return materialise(v.mapInArrow(run, "row long, vec_id long, dim int, data binary"), "whole-vectors")


class Shard:
    """Vectors, and per dimension the order of their quantised values, largest first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.known, self.x = rows, ids, known, x
        self.low = x.min(axis=0)
        self.width = (x.max(axis=0) - self.low) // LEVELS + 1
        level = ((x - self.low) // self.width).astype(np.uint8)
        self.order = np.argsort(LEVELS - 1 - level.T, axis=1, kind="stable").astype(np.uint16)
        counts = np.zeros((x.shape[1], LEVELS), dtype=np.int32)
        for d in range(x.shape[1]):
            counts[d] = np.bincount(level[:, d], minlength=LEVELS)
        self._settle(counts)

    def _settle(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.places = self.order.astype(np.intp)
        edge = self.low[:, None] + np.arange(LEVELS) * self.width[:, None]
        # by the sign of a query's component: the edge that bounds products of a level, and sizes, in order of impact
        self.edge = {1: (edge + self.width[:, None] - 1)[:, ::-1], -1: edge}
        self.size = {1: counts[:, ::-1], -1: counts}

    def pack(self) -> list[bytes]:
        head = np.array([len(self.rows), self.x.shape[1]], dtype="<i8")
        parts = (head, self.rows, self.ids, self.known.astype(np.uint8), self.low, self.width, self.counts, self.order, self.x)
        return [np.ascontiguousarray(p).tobytes() for p in parts]

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        s, at = cls.__new__(cls), 0

        def take(kind: str, *shape: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=int(np.prod(shape)), offset=at).reshape(shape)
            at += out.nbytes
            return out

        n, dim = take("<i8", 2).tolist()
        s.rows, s.ids, s.known, s.low, s.width = take("<i8", n), take("<i8", n), take("u1", n).astype(bool), take("<i8", dim), take("<i8", dim)
        counts = take("<i4", dim, LEVELS)
        s.order, s.x = take("<u2", dim, n), take("<i8", n, dim)
        s._settle(counts)
        return s

    def search(self, q: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of the k best of this shard's vectors but row own, best first; those below least may lack."""
        n, dim = self.x.shape
        used = np.flatnonzero(q)
        sign = np.where(q[used] > 0, 1, -1)
        up, down = used[sign > 0], used[sign < 0]
        dims = np.concatenate((up, down))
        impact = np.concatenate((self.edge[1][up] * q[up, None], self.edge[-1][down] * q[down, None]))
        size = np.concatenate((self.size[1][up], self.size[-1][down]))
        own_place = np.flatnonzero(self.rows == own)
        total, seen, done = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(len(dims), dtype=np.int64)
        upto = np.concatenate((np.zeros((len(dims), 1), dtype=np.int64), np.cumsum(size, axis=1)), axis=1)
        for share, rest in self._stops(impact, size):
            to = (impact > rest).sum(axis=1) if share < 1 else np.full(len(dims), LEVELS)
            level = np.arange(LEVELS)
            fresh = (level >= done[:, None]) & (level < to[:, None])
            parts = []
            for i, d in enumerate(dims.tolist()):
                a, z = upto[i, done[i]], upto[i, to[i]]
                if z > a:
                    parts.append(self.places[d, a:z] if i < len(up) else self.places[d, n - z : n - a][::-1])
            if parts:
                places = np.concatenate(parts)
                total += np.bincount(places, np.repeat(impact[fresh].astype(np.float64), size[fresh]), minlength=n)
                seen += np.bincount(places, minlength=n)
            done = to
            most = total + rest * (len(dims) - seen) if share < 1 else total.copy()
            most[own_place] = -np.inf
            # exact scores of the most promising raise the bound
            lead = np.argpartition(-most, min(k, n) - 1)[:k]
            lead = lead[most[lead] > -np.inf]
            if len(lead) == k:
                least = max(least, (self.x[lead] @ q).min())
            left = np.flatnonzero((most >= least) & (most > -np.inf))
            if len(left) <= max(4 * k, n // 64):
                break
        scores = self.x[left] @ q
        best = np.lexsort((self.rows[left], self.ids[left], ~self.known[left], -scores))[:k]
        return left[best], scores[best]

    @staticmethod
    def _stops(impact: np.ndarray, size: np.ndarray) -> Iterator[tuple[float, int]]:
        """(share, impact down to which segments are processed) at each check; the last share is 1."""
        if impact.size:
            low, high = int(impact.min()), int(impact.max())
            bins = ((impact - low) * 255 // max(1, high - low)).ravel()
            above = np.cumsum(np.bincount(255 - bins, size.ravel(), minlength=256))
            last = high + 1
            for share in CHECKS[:-1]:
                bin_ = 255 - int(np.searchsorted(above, share * above[-1]))
                rest = low + (bin_ * max(1, high - low) + 254) // 255 - 1  # segments of this bin are above it
                if low < rest < last:
                    yield share, rest
                    last = rest
        yield 1.0, 0


@lru_cache(1)
def _loaded(path: str) -> Shard:
    return Shard.unpack(read_file(path))


def index(known: DataFrame) -> DataFrame:
    """dim, shard, path, n of the shards of numbered() vectors, written to the shared folder."""
    spark = known.sparkSession
    folder = new_path(spark, "impact-index")
    sizes = known.groupBy("dim").agg(F.count("*").alias("n"))
    most = F.least(F.lit(SHARD_MOST), F.greatest(F.lit(64), F.lit(SHARD_CELLS) / F.col("dim")))
    sizes = materialise(sizes.select("dim", F.ceil(F.col("n") / most).cast("long").alias("shards")), "shard-counts")
    few = sizes.count() * 16 <= BROADCAST_BYTES
    shards = sizes.agg(F.sum("shards")).first()[0] or 1
    placed = known.join(F.broadcast(sizes) if few else sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("row"), "shards"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, shard), parts in runs(batches, "dim", "shard"):
            t = pa.Table.from_batches(list(parts)).combine_chunks()
            x = np.frombuffer(b"".join(t.column("data").to_pylist()), dtype="<i8").reshape(-1, dim)
            ids = t.column("vec_id").combine_chunks()
            made = Shard(t.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), x)
            path = f"{folder}/{dim}-{shard}-{uuid.uuid4().hex}"
            write_file(path, made.pack())
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int64()), pa.array([path]), pa.array([len(x)], pa.int64())], names=["dim", "shard", "path", "n"])

    # as many parts as shards: a part that has none is no loss, two shards in one follow each other
    parts = min(shards, 4 * known.sparkSession.sparkContext.defaultParallelism + shards // 8)
    near = placed.select("dim", "shard", "row", "vec_id", "data").repartition(int(parts), "dim", "shard").sortWithinPartitions("dim", "shard")
    out = materialise(near.mapInArrow(run, "dim int, shard long, path string, n long"), "shards")
    discard(sizes)
    return out


def _scored(units: DataFrame, k: int) -> DataFrame:
    """q_row, query_id, row, vec_id, score of the k best of a shard for each of units (path, q_row, query_id, data, least)."""
    schema = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path,), parts in runs(batches, "path"):
            shard = _loaded(path)
            for b in parts:
                out = []
                for q_row, query_id, data, least in zip(*(b.column(c).to_pylist() for c in ("q_row", "query_id", "data", "least")), strict=True):
                    places, scores = shard.search(np.frombuffer(data, dtype="<i8"), q_row, k, -np.inf if least is None else least)
                    out += [(q_row, query_id, int(shard.rows[p]), int(shard.ids[p]) if shard.known[p] else None, int(s)) for p, s in zip(places, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    return units.mapInArrow(run, "q_row long, query_id long, row long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of vectors (vec_id, embedding) with is_query, the k others of highest score."""
    spark = vectors.sparkSession
    known = numbered(vectors, scale)
    shards = index(known)
    queries = materialise(known.where(is_query).select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), "dim", "data"), "queries")
    n_queries = queries.count()
    last = shards.agg(F.max("shard")).first()[0]
    discard(known)
    best = spark.createDataFrame([], "q_row long, query_id long, row long, vec_id long, score long, rank int")
    first, n = 0, 1
    while last is not None and n_queries and first <= last:
        n = min(n, last + 1 - first)
        wave = shards.where(F.col("shard").between(first, first + n - 1))
        known_k = best.groupBy("q_row").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("q_row", "least")
        # each query as often as it has shards here; slots of a shard are read by tasks of their own
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n * n_queries // QUERIES))
        slots = max(-(-4 * tasks // n), -(-n_queries // QUERIES))
        each = queries.withColumn("shard", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))))
        each = each.join(wave.select("dim", "shard", "path"), ["dim", "shard"]).join(known_k, "q_row", "left")
        each = each.withColumn("slot", F.pmod(F.xxhash64("q_row"), F.lit(slots)))
        units = each.select("path", "slot", "q_row", "query_id", "data", "least").repartition(int(tasks), "path", "slot").sortWithinPartitions("path", "slot")
        found = materialise(_scored(units, k), "found")
        after = materialise(_best(best.drop("rank").unionByName(found), k), "best")
        discard(found, *([best] if first else []))
        best, first = after, first + n
        n = GROWTH * first
    discard(shards, queries)
    return best.select("query_id", "rank", "vec_id", "score")
