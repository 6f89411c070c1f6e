"""Whitening of vectors by a tall-skinny QR: no covariance is formed to find the directions.

Entries become whole numbers, floor(scale * entry) + shift, and their sums are exact. Rows are centred by these sums. Each
task reduces its rows to one triangular factor R, taking a block at a time: the R of (R so far over the next rows). Rs meet
in a tree, FAN at a time, each level a written table, until one of each length of vectors is left; its singular value
decomposition gives the directions (right vectors) and the variances (squared singular values over the number of rows).
Then one pass projects all rows and adds up the products of the projections, of which the identity error is reported.

Cases: a vector that is null or empty, holds null or non-finite entries, or one of 2**53 or more after scaling takes no
part; vectors of each length are whitened on their own; a component without variance (the rows span fewer dimensions, or
are all equal) has a null whitened value, explained 0, and no part in the identity error, which is null where no
component has variance; rows that repeat a vec_id, or have none, are rows each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, materialise
from .vectors import by_length, runs

#: Triangular factors that meet in one task.
FAN = 16
#: Entries of a block of rows that is factored at once.
BLOCK = 1 << 20
#: A component whose standard deviation is below this share of the first one's has no variance but rounding.
NOTHING = 1e-12


def whole(b: pa.Array, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, whole numbers) of an Arrow column's vectors that take part."""
    for size, at, x in by_length(b):
        with np.errstate(over="ignore"):
            x = np.floor(scale * x)
        good = (np.abs(x) < 2.0**53).all(axis=1)
        if good.any():
            yield size, at[good], x[good].astype(np.int64) + shift


def sums(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """dim, n, sums: of each length the number of vectors, and the exact sum in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = {}, {}
        for b in batches:
            for size, _, x in whole(b.column(1), scale, shift):
                n[size] = n.get(size, 0) + len(x)
                # halves, so that no sum of a task overflows
                high, low = total.get(size, (0, 0))
                total[size] = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        for size, (high, low) in total.items():
            values = [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n[size]] * size, pa.int64()), pa.array(values, pa.decimal128(38, 0))],
                names=["dim", "i", "n", "total"],
            )

    each = vectors.mapInArrow(run, "dim int, i int, n long, total decimal(38,0)")
    by_place = each.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    found = by_place.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "total"))).alias("s"))
    return materialise(found.select("dim", "n", F.col("s.total").alias("sums")), "sums")


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: 64-bit ones where they suffice."""
    most = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in total))
    if 2 * most < 1 << 63:
        return n * x - np.array(total, dtype=np.int64)
    return n * x.astype(object) - np.array(total, dtype=object)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def factors(vectors: DataFrame, model: dict[int, tuple[int, list[int]]], scale: int, shift: int) -> DataFrame:
    """dim, r: one triangular factor of the centred rows of each length in model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for size, _, x in whole(b.column(1), scale, shift):
                if size in model:
                    n, total = model[size]
                    step = max(size, BLOCK // size)
                    for k in range(0, len(x), step):
                        rows = _centred(x[k : k + step], n, total).astype(np.float64) / n
                        held[size] = _triangle(np.vstack([held[size], rows]) if size in held else rows)
        part = TaskContext.get().partitionId()
        for size, r in held.items():
            yield _factor(size, part, r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, group), parts in runs(batches, "dim", "group"):
            r = np.zeros((0, dim))
            for p in parts:
                for data in p.column("r"):
                    r = _triangle(np.vstack([r, np.frombuffer(data.as_py()).reshape(-1, dim)]))
            yield _factor(dim, group, r)

    spec = "dim int, part long, r binary"
    found = materialise(vectors.mapInArrow(run, spec), "factors")
    while (found.groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > 1:
        # numbers of parts need not be dense: the range shrinks by FAN each time, down to one group
        grouped = found.withColumn("group", F.floor(F.col("part") / FAN)).select("dim", "group", "part", "r")
        near = grouped.repartition("dim", "group").sortWithinPartitions("dim", "group", "part")
        after = materialise(near.mapInArrow(merge, spec), "factors")
        discard(found)
        found = after
    return found


def _factor(dim: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["dim", "part", "r"])


def _directions(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions as rows, standard deviations, shares of the variance) of the first components, from the last R."""
    dim = r.shape[1]
    _, s, v = np.linalg.svd(r, full_matrices=True)
    s = np.append(s, np.zeros(dim - len(s)))
    s[s <= NOTHING * s[0]] = 0.0
    k = min(most, dim)
    share = s**2 / (s**2).sum() if s[0] else np.zeros(dim)
    return v[:k], s[:k] / n**0.5, share[:k]


def _projected(vectors: DataFrame, model: dict, scale: int, shift: int) -> DataFrame:
    """dim, vec_id, deviation, w (a value a component) of each row; and rows with gram, the products of w added up over a task."""
    schema = pa.schema([("dim", pa.int32()), ("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("w", pa.list_(pa.float64())), ("gram", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        for b in batches:
            for size, at, x in whole(b.column(1), scale, shift):
                if size not in model:
                    continue
                n, total, directions, deviations = model[size]
                step = max(1, BLOCK // size)
                for k in range(0, len(x), step):
                    rows = _centred(x[k : k + step], n, total)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        w = (rows.astype(np.float64) / n) @ directions.T / deviations
                    w[:, deviations == 0] = 0.0
                    small = rows.dtype != object and int(np.abs(rows).max()) ** 2 * size < 1 << 63
                    away = (rows * rows).sum(axis=1) if small else [sum(int(v) ** 2 for v in r) for r in rows]
                    # sums, and products
                    gram = np.vstack([w.sum(axis=0), w.T @ w])
                    grams[size] = grams[size] + gram if size in grams else gram
                    w = [[None if d == 0 else v for v, d in zip(r, deviations, strict=True)] for r in w.tolist()] if (deviations == 0).any() else w.tolist()
                    ids = b.column(0).take(pa.array(at[k : k + step]))
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(w), pa.int32()), ids, pa.array([_decimal(v) for v in away], pa.decimal128(38, 0)), pa.array(w, schema.field("w").type), pa.nulls(len(w), schema.field("gram").type)], schema=schema)
        for size, gram in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.decimal128(38, 0)), pa.nulls(1, schema.field("w").type), pa.array([gram.ravel()], schema.field("gram").type)], schema=schema)

    return materialise(vectors.mapInArrow(run, "dim int, vec_id long, deviation decimal(38,0), w array<double>, gram array<double>"), "projected")


def _decimal(v: int) -> int | None:
    return int(v) if abs(int(v)) < 10**38 else None


def whiten(vectors: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error over vectors (vec_id, embedding)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    known = sums(v, scale, shift)
    out = None
    for lengths in _together([r["dim"] for r in known.select("dim").collect()]):
        fit = {r["dim"]: (r["n"], [int(s) for s in r["sums"]]) for r in known.where(F.col("dim").isin(lengths)).collect()}
        last = factors(v, fit, scale, shift)
        parts = {r["dim"]: np.frombuffer(r["r"]).reshape(-1, r["dim"]) for r in last.collect()}
        discard(last)
        found = {d: _directions(r, fit[d][0], most) for d, r in parts.items()}
        rows = _projected(v, {d: (*fit[d], *found[d][:2]) for d in found}, scale, shift)
        n = {d: fit[d][0] for d in found}
        errors = {d: _identity_error(rows, d, n[d], found[d][1]) for d in found}
        told = [(d, i + 1, n[d], float(found[d][2][i]), errors[d]) for d in found for i in range(len(found[d][1]))]
        model = rows.sparkSession.createDataFrame(told, "dim int, component int, n long, explained double, identity_error double")
        each = rows.where("w is not null").select("dim", "vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
        part = each.join(F.broadcast(model), ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
        out = part if out is None else out.unionByName(part)
    discard(known)
    spec = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return out if out is not None else v.sparkSession.createDataFrame([], spec)


def _together(lengths: list[int]) -> Iterator[list[int]]:
    """Lengths of which all factors are small enough to be held at once; a pass over the rows for each list."""
    held, size = [], 0
    for d in sorted(lengths):
        if held and size + 8 * d * d > BROADCAST_BYTES:
            yield held
            held, size = [], 0
        held.append(d)
        size += 8 * d * d
    if held:
        yield held


def _identity_error(rows: DataFrame, dim: int, n: int, deviations: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components that have variance."""
    k, some = len(deviations), np.flatnonzero(deviations)
    if not len(some):
        return None
    cells = rows.where((F.col("dim") == dim) & F.col("gram").isNotNull()).select(F.posexplode("gram").alias("i", "x"))
    total = np.zeros((k + 1) * k)
    for r in cells.groupBy("i").agg(F.sum("x").alias("x")).collect():
        total[r["i"]] = r["x"]
    total = total.reshape(k + 1, k)
    mean = total[0] / n
    apart = total[1:] / n - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(apart[np.ix_(some, some)]).max())
