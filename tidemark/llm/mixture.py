"""Mixing sources to target weights by Poisson replication.

A source of n documents whose target share is w has the mean rate w * total / n: how often each of its documents is to
be repeated. A document's count is the inverse of the Poisson distribution of that mean at a uniform number hashed from
its id and a seed, so runs agree and no counter is shared. Each document is exploded by its count, and all copies are
dealt over the cluster and sorted by a hash of (seed, id, copy), which shuffles them globally.

Weights come from the caller, or by temperature: a source's share is n ** alpha, over the sum of all. Sources without a
weight, null among them under its own name, are left out when weights are given, and so take no part in the total.

Cases: null texts are repeated like others; rows that repeat a doc_id get the same count each; a null doc_id is drawn for
by a hash of the text, so such rows are dealt like others; an empty table gives no rows; columns of the documents named
like those added here are replaced by them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES

#: Parts of a source's documents, where sources are too many to broadcast.
PARTS = 32
NO_SOURCE = "\x00none"


@lru_cache(1_000)
def poisson_steps(mean: float) -> tuple[int, np.ndarray]:
    """(first, the distribution function at first, first + 1, ...) over all counts that matter in double precision.

    Counts from the mode down and up, 12 deviations and some: what lies outside weighs less than 1e-16.
    """
    if mean <= 0 or not math.isfinite(mean):
        return 0, np.zeros(0)
    reach = 12 * math.sqrt(mean) + 40
    first = max(0, int(mean - reach))
    k = range(first, int(mean + reach) + 1)
    return first, np.minimum(np.cumsum([math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in k]), 1.0)


def counts(means: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many steps of each mean's distribution function are at most u: the inverse of the Poisson distribution."""
    out = np.zeros(len(u), dtype=np.int32)
    for mean in np.unique(means):
        at = means == mean
        first, steps = poisson_steps(float(mean))
        out[at] = np.where(len(steps) > 0, first + np.searchsorted(steps, u[at], side="right"), 0)
    return out


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 over the seed and parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source_key, n, rate) of each source: a row a source, from partial counts. size: total copies, over documents."""
    n = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        share = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source_key string, w double")
        share = n.join(given, "source_key")
    whole = share.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))
    mean = (F.col("w") / F.col("w_all")) * F.col("n_all") * F.lit(float(size)) / F.col("n")
    return share.join(F.broadcast(whole)).select("source_key", "n", mean.alias("rate"))  # whole is one row


@F.arrow_udf(T.IntegerType())
def copies_of(rate: pa.Array, u: pa.Array) -> pa.Array:
    return pa.array(counts(rate.to_numpy(zero_copy_only=False), u.to_numpy(zero_copy_only=False)))


@F.arrow_udf(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("steps", T.ArrayType(T.DoubleType()))]))
def steps_of(rate: pa.Array) -> pa.Array:
    found = [poisson_steps(float(m)) for m in rate.to_pylist()]
    # steps that are 1 in double precision are above any number drawn
    return pa.array([{"first": first, "steps": steps[: np.searchsorted(steps, 1.0 - 1e-15) + 1].tolist()} for first, steps in found], pa.struct([("first", pa.int32()), ("steps", pa.list_(pa.float64()))]))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0, seed: int = 17) -> DataFrame:
    """The documents, each as often as its count says, shuffled globally, with copy_ix, n_copies and shuffle_key."""
    columns = [c for c in docs.columns if c not in ("copy_ix", "n_copies", "shuffle_key")]
    table = rates(docs, weights, alpha, size).select("source_key", "rate")
    # a row without an id is known by its text
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    keyed = docs.select(*columns, F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source_key"), name.alias("_name"))
    u = uniform(seed, F.col("_name"))
    # a step function has some 24 roots of its mean as steps; the root of the sum bounds that before any is made
    size_of = F.octet_length("source_key") + 1_024 + 200 * F.sqrt(F.greatest(F.col("rate"), F.lit(0.0)))
    if (table.agg(F.sum(size_of)).first()[0] or 0) <= BROADCAST_BYTES:
        steps = table.withColumn("p", steps_of("rate")).select("source_key", "p.first", "p.steps")
        rated = keyed.join(F.broadcast(steps), "source_key").withColumn("_u", u)
        counted = rated.withColumn("n_copies", F.when(F.size("steps") > 0, F.col("first") + F.expr("size(filter(steps, s -> s <= _u))")).otherwise(0)).where("n_copies > 0")
    else:  # a source of any size is dealt over some parts, and its steps are made where they are needed
        each = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        rated = keyed.withColumn("_part", F.pmod(F.xxhash64("_name"), F.lit(PARTS))).join(each, ["source_key", "_part"])
        counted = rated.withColumn("n_copies", copies_of("rate", u)).where("n_copies > 0")
    copies = counted.withColumn("copy_ix", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.col("_name"), F.col("copy_ix").cast("string")).cast("binary"))
    dealt = copies.withColumn("shuffle_key", key).select(*columns, "copy_ix", "n_copies", "shuffle_key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")
