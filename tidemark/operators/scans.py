"""Running folds over one long ordered sequence, in slices, so that a single key's rows are many tasks' work.

A fold up to a row (sum, count, last, first, max, min) is associative: each slice of a key is reduced to one row, the
rows of a key's earlier slices are folded again (as many rows as it has slices), and the result heads the slice as a row
of its own. Then one window a (key, slice) gives what a window a key would. Rows are shuffled once; what is carried is a
row a slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice where rows are numbered.
WIDTH = 1 << 17
#: Slices of a sequence that is cut by its quantiles.
SLICES = 64
KINDS = ("sum", "last", "first", "max", "min")


@dataclass(frozen=True)
class Fold:
    """kind of value over the rows of a key up to each row, or over those before it."""

    kind: str
    value: Column
    before: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no fold is named {self.kind}")

    def total(self, value: Column, at: Column) -> Column:
        """Over all rows of a group, in order of at. Nulls are passed over."""
        at = F.when(value.isNotNull(), at)
        return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.max_by(v, at), "first": lambda v: F.min_by(v, at)}[self.kind](value)

    def upto(self, value: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True), "first": lambda v: F.first(v, ignorenulls=True)}[self.kind](value)


def by_width(place: str, width: int = WIDTH) -> Column:
    """Slices of so many numbers each."""
    return F.floor(F.col(place) / width)


def by_quantiles(rows: DataFrame, place: str, slices: int = SLICES) -> Column:
    """Slices of about equally many rows, by the values that part them; equal values are in one slice."""
    edges = rows.agg(F.percentile_approx(F.col(place).cast("double"), [k / slices for k in range(1, slices)], 10_000)).first()[0]
    if not edges:
        return F.lit(0)
    parts = F.array(*[F.lit(float(e)) for e in sorted(set(edges))])
    return F.size(F.filter(parts, lambda e: e <= F.col(place).cast("double")))


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, Fold], slice_: Column) -> DataFrame:
    """rows with a column a fold. slice_ never falls as rows go up in order; rows of equal order are in any order.

    A null key is a key. Where a fold has no value yet, it is null, a sum too.
    """
    work = rows.withColumns({"_slice": slice_} | {f"_v_{n}": f.value for n, f in folds.items()})
    at = F.struct(*order)
    totals = work.groupBy(*keys, "_slice").agg(*[f.total(F.col(f"_v_{n}"), at).alias(f"_t_{n}") for n, f in folds.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*keys, "_slice", *[f.upto(F.col(f"_t_{n}")).over(earlier).alias(f"_v_{n}") for n, f in folds.items()])
    met = work.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_head"), *order)
    upto, before = (w.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    out = met.withColumns({n: f.upto(F.col(f"_v_{n}")).over(before if f.before else upto) for n, f in folds.items()})
    return out.where("not _head").select(*rows.columns, *folds)


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, slice_: Column) -> DataFrame:
    """rows numbered from 1 within keys, in order."""
    return scan(rows, keys, order, {name: Fold("sum", F.lit(1).cast("long"))}, slice_)
