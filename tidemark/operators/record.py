"""One run from its lines to the store: redacted, interpreted, aggregated, compared with stored runs, finished in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import Roots
from ..functions.redact import redact
from ..sources.scratch import materialise, temporary
from ..sources.store import Store
from . import aggregate, compare, detection
from .interpret import interpret

#: Runs that a run is compared with, at most.
MOST_BASES = 10


def stored_stats(store: Store, run_ids: list[str]) -> detection.Stats | None:
    """What finished runs amount to, as their recording stored it; no event is read again."""
    if not run_ids:
        return None
    return detection.Stats(*(store.table(t, run_ids) for t in ("run_sources", "facts", "cells")))


def record(store: Store, run: dict, lines: DataFrame, roots: Roots | None = None, usage: DataFrame | None = None, mode: str = "secrets") -> None:
    """Stores a run (run_id, context, started_at_ms, and what else a run's row has) of lines (feed, stream, seq, line, raw_len).

    Lines are analysed without secrets, and kept as the mode allows. The run is compared with the runs of its context that
    began before it and may be a baseline; it is finished with its stats, its kept lines and its signals, or not at all.
    An interrupted run is stored and not compared.
    """
    store.begin(run)
    with temporary(store.spark):
        known = redact(lines.withColumn("run_id", F.lit(run["run_id"])), mode)
        known = materialise(known, "lines")
        events = materialise(interpret(known.withColumn("line", F.col("masked")).drop("masked", "evidence"), roots, usage), "events")
        one = store.spark.createDataFrame([(run["run_id"], run["context"], run["started_at_ms"], not run.get("interrupted"))], "run_id string, context string, started long, usable boolean")
        own = detection.stats_of(events, one, known.select("run_id", "stream").distinct())
        kept = aggregate.exemplars(events).drop("line").join(known.select("run_id", "stream", "seq", F.substring("evidence", 1, aggregate.LINE_BYTES).alias("line")), ["run_id", "stream", "seq"])
        tables = {"facts": own.facts, "cells": own.cells, "run_sources": own.runs, "exemplars": kept, "behaviors": events.select("behavior_id", "kind", "template")}
        if not run.get("interrupted"):
            tables["signals"] = _signals(store, run, own)
        store.finish(run | {"lines": known.count()}, tables)


def _signals(store: Store, run: dict, own: detection.Stats) -> DataFrame:
    earlier = store.usable(run["context"]).where((F.col("started_at_ms") < run["started_at_ms"]) & (F.col("run_id") != run["run_id"])).limit(MOST_BASES)
    then = stored_stats(store, [r["run_id"] for r in earlier.select("run_id").collect()])
    stats = own if then is None else detection.Stats(*(a.unionByName(b.select(a.columns)) for a, b in ((own.runs, then.runs), (own.facts, then.facts), (own.cells, then.cells))))
    cases, pairs = (x.where(F.col("case") == run["run_id"]) for x in detection.own_cases(stats))
    found = detection.signals(stats, cases, pairs).withColumns({"context": F.lit(run["context"]), "run": F.lit(run["run_id"])})
    return compare.ranked(found).select(*detection.OUT).withColumnsRenamed({"behavior": "behavior_id"}).drop("run", "context")
