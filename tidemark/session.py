"""The session that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, name: str = "tidemark", **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, leave shuffle_partitions to its size."""
    b = SparkSession.builder.master(master).appName(name).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in more.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
