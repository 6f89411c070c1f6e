"""What a masked value's position holds, from how its values are spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The thresholds of the classes.
MOST_VALUES, SAMPLES = 5_000, 5
ENUM_LEAST, ENUM_TIMES, ENUM_MEMBERS, ENUM_COVERAGE = 20, 3, (2, 10), 0.9
ID_LEAST, ID_UNIQUE, ID_HALF, ID_DISTINCT = 5, 0.8, 0.5, 20
SMOOTHING = 15.0
MEASURES = ("duration", "size", "float")


def statistics(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """total, distinct, overflowed, numeric summary and samples for each position. values: keys, kind, value and maybe number.

    Values are counted first, so a position of any size is summed in parts. samples are its commonest values, ties by
    value; each task keeps its own few of a position before they meet.
    """
    number = F.col("number") if "number" in values.columns else F.lit(None).cast("double")
    counted = values.groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"), F.max(number).alias("number"))
    stats = counted.groupBy(*keys, "kind").agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct_values"), (F.count("*") > MOST_VALUES).alias("overflowed"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n"))).alias("numbers"), F.min("number").alias("min"), F.max("number").alias("max"), F.sum(F.col("number") * F.col("n")).alias("sum"),
        F.count_if(F.col("n") >= ENUM_TIMES).alias("established"), F.coalesce(F.sum(F.when(F.col("n") >= ENUM_TIMES, F.col("n"))), F.lit(0)).alias("covered"),
    )
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "value"))
    first = counted.withColumn("place", place).where(F.col("place") <= SAMPLES).groupBy(*keys, "kind").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("first"))
    of_position = [stats[k].eqNullSafe(first[k]) for k in (*keys, "kind")]
    return stats.join(first, of_position, "left").select(stats["*"], F.transform("first", lambda x: x["value"]).alias("samples"))


def classify(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """statistics with class (measure, identifier, constant, enum, unknown) and confidence total / (total + 15)."""
    s = statistics(values, keys)
    ratio = F.col("distinct_values").cast("double") / F.col("total")
    identifier = F.col("overflowed") | ((F.col("total") >= ID_LEAST) & ((ratio >= ID_UNIQUE) | ((ratio >= ID_HALF) & (F.col("distinct_values") >= ID_DISTINCT))))
    enum = (F.col("total") >= ENUM_LEAST) & F.col("established").between(*ENUM_MEMBERS) & (F.col("covered").cast("double") / F.col("total") >= ENUM_COVERAGE)
    kind = F.when(F.col("kind").isin(*MEASURES), "measure").when(identifier, "identifier").when(F.col("distinct_values") == 1, "constant").when(enum, "enum").otherwise("unknown")
    return s.withColumn("class", kind).withColumn("confidence", F.round(F.col("total").cast("double") / (F.col("total") + SMOOTHING), 2))
