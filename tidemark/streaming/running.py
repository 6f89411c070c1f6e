"""Statistics of runs that grow: each batch of events is reduced once to a state that can be added up, and no event is read
again.

A batch's state is a folder of its own, so a batch that is done again overwrites itself. Every EVERY batches the states
so far are merged into one, which takes their place once it is whole; readers add up the last merged state and the
batches after it, so they read EVERY folders at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import aggregate

KEYS = ["run_id", "behavior_id", "kind"]
EVERY = 16


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _done(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the folders kind=<n> that are whole."""
    p, fs = _hadoop(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in found if fs.exists(_hadoop(spark, f"{folder}/{kind}={n}/_SUCCESS")[0]))


def state_of(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The state of all batches so far (or of those before one), or None if there is none."""
    whole = [n for n in _done(spark, folder, "upto") if before is None or n < before]
    last = whole[-1] if whole else -1
    parts = [f"{folder}/upto={last}"] if whole else []
    parts += [f"{folder}/batch={n}" for n in _done(spark, folder, "batch") if n > last and (before is None or n < before)]
    return aggregate.merged(spark.read.parquet(*parts), KEYS) if parts else None


def stats_of(spark: SparkSession, folder: str, most: int = aggregate.MOST_BEHAVIORS) -> DataFrame | None:
    """count, errors and durations of each behavior of each run so far, those past the cap folded into one."""
    state = state_of(spark, folder)
    return None if state is None else aggregate.exact_once(aggregate.from_cells(aggregate.folded(state, most), KEYS))


def running_stats(events: DataFrame, folder: str, checkpoint: str, until_end: bool = False, every: int = EVERY) -> StreamingQuery:
    """Keeps the state of a stream of events (run_id, behavior_id, kind, duration_us, outcome, arrival) in a folder."""

    def take(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        aggregate.cells(batch, KEYS).write.mode("overwrite").parquet(f"{folder}/batch={n}")
        if n % every == every - 1:
            state_of(spark, folder, n + 1).write.mode("overwrite").parquet(f"{folder}/upto={n}")
            older = [f"batch={k}" for k in _done(spark, folder, "batch") if k <= n - every] + [f"upto={k}" for k in _done(spark, folder, "upto") if k < n - every]
            for name in older:  # those merged last stay for readers that began before
                p, fs = _hadoop(spark, f"{folder}/{name}")
                fs.delete(p, True)

    writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_end else writer).start()


def tail(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of events that arrive as JSON lines in a folder, in files that appear whole."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder).withColumn("arrival", F.struct("arrival"))
