"""Behaviors as they are first seen in a stream of lines, at most so many of them.

Two keyed states in the state store: one a behavior, which lets only its first line pass, and one counter, which lets at
most `most` behaviors pass and then says once that others were left out. Nothing that was written is read back, and a
batch without new behaviors writes nothing. Before the states, tasks reduce a batch to one line a behavior, so a frequent
behavior is a row a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.ids import behavior_ids
from ..functions.normalize import Roots, template_of
from ..operators.aggregate import LINE_BYTES, MOST_BEHAVIORS, OVERFLOW
from . import ndjson

SEEN = "behavior_id string, template string, line string"
STEP = SEEN + ", step int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Behaviors that a task holds while it reduces its lines.
HELD = 1 << 16


def tail(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the lines of text files as they arrive in a folder; the limit a trigger is the back-pressure."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.col("value").alias("line"))


def templated(lines: DataFrame, roots: Roots | None = None) -> DataFrame:
    """behavior_id, template, line of the lines that are not blank."""
    seen = lines.where(F.trim("line") != "").withColumn("template", template_of(F.col("line"), roots))
    return seen.withColumn("behavior_id", behavior_ids(F.lit("log"), F.col("template"))).select("behavior_id", "template", "line")


def reduced(rows: DataFrame) -> DataFrame:
    """Each task's rows down to the least line of each behavior; a task that holds many sends them on its way."""

    def sent(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"behavior_id": list(held), "template": [v[0] for v in held.values()], "line": [v[1] for v in held.values()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for key, template, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key not in held or line < held[key][1]:
                    held[key] = (template, line)
            if len(held) > HELD:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    return rows.select("behavior_id", "template", F.substring("line", 1, LINE_BYTES).alias("line")).mapInArrow(run, SEEN)


class FirstSight(StatefulProcessor):
    """Passes a behavior's first line with step 1. With forget_ms, one that hasn't been seen for so long is forgotten, and
    a row with step -1 says so."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at_ms long")

    def _due(self, now: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for r in rows:
            least = r.loc[r["line"].idxmin()]
            first = least if first is None or least["line"] < first["line"] else first
        now = timerValues.getCurrentProcessingTimeInMs() if self.forget_ms else 0
        if not self.last.exists():
            yield pd.DataFrame({"behavior_id": [key[0]], "template": [first["template"]], "line": [first["line"]], "step": [1]})
        self.last.update((now,))
        if self.forget_ms:
            self._due(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"behavior_id": [key[0]], "template": [None], "line": [None], "step": [-1]})

    def close(self) -> None:
        pass


class Capped(StatefulProcessor):
    """Passes behaviors while there is room, those of the lowest ids of a batch first; then OVERFLOW, once."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("count", "known long, full boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, full = self.state.get() if self.state.exists() else (0, False)
        taken, fresh, left = [], 0, 0
        for r in rows:
            left += int((r["step"] < 0).sum())
            new = r[r["step"] > 0]
            fresh += len(new)
            # what room there can be at most, whatever is forgotten in this batch
            taken = heapq.nsmallest(self.most, [*taken, *new[["behavior_id", "template", "line"]].itertuples(index=False, name=None)])
        known = max(0, known - left)
        room = max(0, self.most - known)
        out = taken[:room]
        if fresh > room and not full:
            out, full = [*out, (OVERFLOW, OVERFLOW, None)], True
        self.state.update((known + min(room, fresh), full))
        if out:
            yield pd.DataFrame(out, columns=["behavior_id", "template", "line"])

    def close(self) -> None:
        pass


def first_rows(lines: DataFrame, roots: Roots | None = None, most: int = MOST_BEHAVIORS, forget_ms: int | None = None) -> DataFrame:
    """SEEN rows of a stream of lines, each behavior once (or again after it was forgotten), at most `most` known at a time."""
    mode = "processingTime" if forget_ms else "none"
    sights = reduced(templated(lines, roots)).groupBy("behavior_id").transformWithStateInPandas(FirstSight(forget_ms), STEP, "Append", mode)
    return sights.withColumn("_all", F.lit(0)).groupBy("_all").transformWithStateInPandas(Capped(most), SEEN, "Append", mode)


def seen_before(spark: SparkSession, folder: str) -> DataFrame:
    """What first_seen() has written."""
    return ndjson.read(spark, folder, SEEN)


def first_seen(lines: DataFrame, folder: str, checkpoint: str, roots: Roots | None = None, most: int = MOST_BEHAVIORS, until_end: bool = False, forget_ms: int | None = None) -> StreamingQuery:
    """Writes each behavior once, in the batch that first shows it, as JSON lines to a folder; returns the running query.

    A query that is lost at any time and started again with its checkpoint loses and repeats nothing. until_end: stop at
    the end of what is there now; that and forget_ms, by which the state of behaviors that are gone goes too, exclude
    each other, since timers may always be due.
    """
    if until_end and forget_ms:
        raise ValueError("a query with timers has no end")
    spark = lines.sparkSession
    spark.dataSource.register(ndjson.NdjsonSink)
    writer = first_rows(lines, roots, most, forget_ms).writeStream.format(ndjson.NAME).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # the query keeps the setting that it started with
    try:
        return (writer.trigger(availableNow=True) if until_end else writer.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
