"""As-of and range joins without a cross product: both sides meet in one order, cut into slices, or by buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import SLICES, Fold, by_quantiles, scan


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, take: Sequence[str], slices: int = SLICES) -> DataFrame:
    """left with the columns `take` of the last row of right at or before it in order, within keys; null if there is none.

    order is a number or a time. Its quantiles cut all rows into slices, and the last row of right in a slice is carried
    into the next ones, so a key that most rows have is the work of many tasks.
    """
    ls = left.withColumn("_side", F.lit(1)).withColumn("_taken", F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType))
    rs = right.select(*keys, order, F.struct(*take).alias("_taken")).withColumn("_side", F.lit(0))
    met = ls.unionByName(rs, allowMissingColumns=True)
    out = scan(met, keys, [order, "_side"], {"_last": Fold("last", F.col("_taken"))}, by_quantiles(met, order, slices))
    return out.where("_side = 1").select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in take])


def within(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int, closed: bool = False) -> DataFrame:
    """points joined with each range of the same keys that holds them: start <= at < end (<= end if closed).

    Both sides are cut into buckets of a width, so the join is an equi-join; a range goes to each bucket it touches.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - (0 if closed else 1)) / width)))) if closed else ranges.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return p.join(r, [*keys, "_bucket"]).where((F.col(start) <= F.col(at)) & upper).drop("_bucket")


def beside(rows: DataFrame, keys: Sequence[str], order: Sequence[str], take: dict[str, str]) -> DataFrame:
    """rows with the values of those just before and after them in order, within keys: before_x and after_x for each x of take."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"before_{name}": F.lag(c).over(w) for name, c in take.items()} | {f"after_{name}": F.lead(c).over(w) for name, c in take.items()})
