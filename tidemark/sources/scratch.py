"""Tables between the steps of a job, written to the folder that the driver and all executors share.

A written table cuts the plan of what follows, and survives lost executors.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Unset, it becomes a temporary folder in local mode, where all tasks run on this machine, and is an error elsewhere.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders written in this process and not yet deleted, by the session's application.
WRITTEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _inside = threading.Lock(), {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a job ends; the session's own setting is back when the last of several users ends."""
    key = id(spark._jsparkSession)
    with _cleaning:
        users, before = _inside.get(key, (0, spark.conf.get(CLEANUP, None)))
        _inside[key] = (users + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            users, before = _inside[key]
            if users > 1:
                _inside[key] = (users - 1, before)
            else:
                del _inside[key]
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: cuts the lineage and survives lost executors.

    The shuffle files behind a written table are of no more use, so they go as soon as it is whole. What a result still
    reads stays until release(); tables that only its making reads are deleted by discard().
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    known = WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.tidemark_path)


def release(spark: SparkSession) -> None:
    """Deletes all that this session's operators have written to the shared folder and not yet deleted.

    For the owner of a session, once results are saved elsewhere: archives, shards and tables behind results go too.
    """
    for path in list(WRITTEN.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to the shared folder within, by whatever operators: for work whose results are
    saved elsewhere before that."""
    app = spark.sparkContext.applicationId
    before = set(WRITTEN.get(app, []))
    try:
        yield
    finally:
        for path in [p for p in WRITTEN.get(app, []) if p not in before]:
            _delete(spark, path)
