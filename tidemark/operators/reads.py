"""What is read of stored runs: history, reports of changes, one behavior's numbers and lines, usage against the baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import evidence, median_of
from . import compare

EVENTS = "file:rspec-events"
SETUP_TIER = 5


def history(runs: DataFrame, signals: DataFrame) -> DataFrame:
    """runs with changes (groups of signals, but for what setup explains), signals and complete.

    A run is complete when it finished without interruption, no event was past its cap, and no signal calls it
    incomplete. runs: context, run, finished, interrupted, events_past_cap; signals: context, run, group_key, tier, kind.
    """
    groups = signals.groupBy("context", "run", "group_key").agg(F.count("*").alias("k"), F.min("tier").alias("tier"), F.bool_or(F.col("kind") == "incomplete").alias("part"))
    per = groups.groupBy("context", "run").agg(F.count_if(F.col("tier") < SETUP_TIER).alias("changes"), F.sum("k").alias("signals"), F.bool_or("part").alias("part"))
    rows = runs.join(per, ["context", "run"], "left")
    whole = F.col("finished") & ~F.coalesce("interrupted", F.lit(False)) & (F.coalesce("events_past_cap", F.lit(0)) == 0) & ~F.coalesce("part", F.lit(False))
    return rows.withColumns({"changes": F.coalesce("changes", F.lit(0)), "signals": F.coalesce("signals", F.lit(0)), "complete": whole}).drop("part")


def changes(ranked: DataFrame, most: int) -> DataFrame:
    """The first groups of each run's ranked signals, with how many groups and signals there are in all."""
    totals = ranked.groupBy("context", "run").agg(F.max("group_rank").alias("groups"), F.count("*").alias("signals"))
    return ranked.where(F.col("group_rank") <= most).join(totals, ["context", "run"])


def summary(stats: DataFrame, by: str = "count", most: int = 20) -> DataFrame:
    """The behaviors of most occurrences, or with by="time" of most time, then of most occurrences; ties by behavior_id."""
    order = [F.desc("count"), "behavior_id"] if by == "count" else [F.desc("duration_total_us"), F.desc("count"), "behavior_id"]
    return stats.orderBy(*order).limit(most)


def runs_after(runs: DataFrame, context: str, run: str) -> DataFrame:
    """Finished, uninterrupted runs of a context after one of them, oldest first. runs: context, run, finished, interrupted."""
    return runs.where((F.col("context") == context) & (F.col("run") > run) & F.col("finished") & ~F.coalesce("interrupted", F.lit(False))).orderBy("run")


def latest_with(stats: DataFrame, behavior: Sequence[str]) -> DataFrame:
    """Of each behavior, its numbers in the last run that has it. stats: run, behavior columns and numbers."""
    rest = [c for c in stats.columns if c not in behavior]
    return stats.groupBy(*behavior).agg(F.max_by(F.struct(*rest), "run").alias("s")).select(*behavior, "s.*")


def whole_lines(exemplars: DataFrame, captures: DataFrame) -> DataFrame:
    """exemplars with event: for those of the test runner, the whole captured line, or what was kept of it if that is gone.

    exemplars: run_id, stream, seq, line; captures: run_id, stream, seq, line.
    """
    kept = captures.where(F.col("stream") == EVENTS).select("run_id", "stream", "seq", F.col("line").alias("whole"))
    return exemplars.join(kept, ["run_id", "stream", "seq"], "left").withColumn("event", F.when(F.col("stream") == EVENTS, F.coalesce("whole", "line"))).drop("whole")


def usual_usage(usage: DataFrame, runs: DataFrame, measures: Sequence[str]) -> DataFrame:
    """context, run, n and each measure's median over the baseline runs that recorded usage; runs without any are left out."""
    long = usage.select("context", "run", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x")).select("context", "run", "x.*")
    known = compare.wide(long, runs, ["measure"], "value").where("present_in > 0")
    return known.groupBy("context", "run").agg(F.max("present_in").alias("n"), *[F.max(F.when(F.col("measure") == m, median_of(F.col("vals")))).alias(m) for m in measures])


def truncated(past_cap: DataFrame, runs: DataFrame) -> DataFrame:
    """An incomplete signal for each run with events past its cap and a baseline. past_cap: context, run, events_past_cap (of all runs)."""
    rows = compare.wide(past_cap.withColumn("measure", F.lit("events_past_cap")), runs, ["measure"], "events_past_cap")
    vals = F.col("vals")
    found = rows.where("current > 0 and n > 0").withColumn("confidence", F.round(evidence(F.col("n")), 2))
    return found.select(
        "context", "run", F.lit("incomplete").alias("kind"), "measure", "current", "n", F.size(F.filter(vals, lambda v: v > 0)).alias("present_in"),
        median_of(vals).alias("median"), F.array_min(vals).alias("min"), F.array_max(vals).alias("max"), "confidence",
    )


def scoped(totals: DataFrame, scopes: DataFrame, behavior: Sequence[str], value: str = "count") -> DataFrame:
    """context, run, behavior columns, scope_id, value: each scope's own value, and under a null scope what no scope accounts for."""
    keys = ["context", "run", *behavior]
    named = scopes.where("scope_id is not null").select(*keys, "scope_id", F.col(value).cast("double").alias(value))
    rest = totals.select(*keys, F.col(value).cast("double").alias("whole")).join(named.groupBy(*keys).agg(F.sum(value).alias("part")), keys, "left")
    return named.unionByName(rest.select(*keys, F.lit(None).cast(named.schema["scope_id"].dataType).alias("scope_id"), (F.col("whole") - F.coalesce("part", F.lit(0.0))).alias(value)))


def neighbour_context(runs: DataFrame, context: str, window: int = 50) -> DataFrame:
    """At most one row: of the other contexts in the last runs, that sharing most leading words with context's name.

    Ties go to the context with more runs, then the newer run. command is that of its newest run. runs: context, run,
    started, command, usable.
    """
    recent = runs.orderBy(F.desc("started"), F.desc("run")).limit(window).where((F.col("context") != context) & F.col("usable"))
    rows = recent.groupBy("context").agg(F.count("*").alias("runs"), F.max(F.struct("started", "run", "command")).alias("newest"))
    mine, theirs = F.split(F.lit(context), " "), F.split("context", " ")
    same = F.filter(F.sequence(F.lit(1), F.least(F.size(mine), F.size(theirs))), lambda i: F.slice(mine, 1, i) == F.slice(theirs, 1, i))
    return rows.withColumn("shared", F.size(same)).orderBy(F.desc("shared"), F.desc("runs"), F.desc("newest")).limit(1).select("context", "newest.command", "runs", "shared")


def sources_of(runs: DataFrame, streams: DataFrame) -> DataFrame:
    """runs with streams: what each recorded, null where that is unknown."""
    known = streams.groupBy("run").agg(F.array_sort(F.collect_set("stream")).alias("streams"))
    return runs.join(known, "run", "left")
