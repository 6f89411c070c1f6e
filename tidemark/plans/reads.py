"""Queries over stored runs, with days of events as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, reads
from ..registry import query
from .telemetry import DAYS, RANKED, day_events, day_runs, signals

#: Errors of a day beyond so many stand for events past a run's cap.
PAST = 5


def past_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_events(spark, sf_dir).groupBy("context", "run").agg(F.greatest(F.count_if(F.col("outcome") == "failure") - PAST, F.lit(0)).alias("events_past_cap"))


@query(
    RANKED
    + f""", x AS (SELECT run, greatest(count(*) FILTER (WHERE failed) - {PAST}, 0) AS past FROM e GROUP BY run),
g AS (SELECT run, count(DISTINCT event_type) AS changes, count(*) AS signals FROM i GROUP BY run)
SELECT run, coalesce(changes, 0) AS changes, coalesce(signals, 0) AS signals, past = 0 AS complete FROM x LEFT JOIN g USING (run)"""
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = past_cap(spark, sf_dir).withColumns({"finished": F.lit(True), "interrupted": F.lit(False)})
    return reads.history(runs, signals(spark, sf_dir)).select("run", "changes", "signals", "complete")


@query(
    RANKED
    + """SELECT i.run, behavior, kind, CAST(group_rank AS INT) AS group_rank, CAST(place AS INT) AS place, CAST(max(group_rank) OVER (PARTITION BY i.run) AS INT) AS groups, count(*) OVER (PARTITION BY i.run) AS signals
FROM i JOIN h USING (run, event_type) QUALIFY group_rank <= 2"""
)
def changes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two groups of each day's signals, with the totals of all."""
    return reads.changes(compare.ranked(signals(spark, sf_dir)), 2).select("run", "behavior", "kind", "group_rank", "place", "groups", "signals")


@query(DAYS + "SELECT user_id, max(run) AS run, arg_max(n, run) AS count, arg_max(errors, run) AS errors FROM (SELECT run, user_id, count(*) AS n, count(*) FILTER (WHERE failed) AS errors FROM e GROUP BY ALL) GROUP BY user_id")
def latest_behavior_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = day_events(spark, sf_dir).groupBy("run", "user_id").agg(F.count("*").alias("count"), F.count_if(F.col("outcome") == "failure").alias("errors"))
    return reads.latest_with(stats, ["user_id"])


@query(
    DAYS
    + """, u AS (SELECT r.ord, CAST(sum(us) AS DOUBLE) AS total_us, CAST(max(us) AS DOUBLE) AS max_us FROM e JOIN r USING (run) GROUP BY r.ord)
SELECT r.run, CAST(count(*) AS INT) AS n, median(total_us) AS total_us, median(max_us) AS max_us FROM r JOIN u ON u.ord BETWEEN r.ord - 10 AND r.ord - 1 GROUP BY r.run"""
)
def usual_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = day_events(spark, sf_dir)
    usage = e.groupBy("context", "run").agg(F.sum("duration_us").alias("total_us"), F.max("duration_us").alias("max_us"))
    return reads.usual_usage(usage, day_runs(e), ["total_us", "max_us"]).drop("context")


@query(
    DAYS
    + f""", x AS (SELECT r.run, r.ord, CAST(greatest(count(*) FILTER (WHERE failed) - {PAST}, 0) AS DOUBLE) AS past FROM e JOIN r USING (run) GROUP BY ALL)
SELECT c.run, 'incomplete' AS kind, 'events_past_cap' AS measure, c.past AS current, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE b.past > 0) AS INT) AS present_in,
       median(b.past) AS median, min(b.past) AS min, max(b.past) AS max, round((count(*) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE), 2) AS confidence
FROM x c JOIN x b ON b.ord BETWEEN c.ord - 10 AND c.ord - 1 WHERE c.past > 0 GROUP BY c.run, c.past"""
)
def truncated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.truncated(past_cap(spark, sf_dir), day_runs(day_events(spark, sf_dir))).drop("context")


@query(
    DAYS
    + """SELECT run, event_type, user_id AS scope_id, CAST(count(*) AS DOUBLE) AS count FROM e WHERE user_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT run, event_type, NULL, CAST(count(*) FILTER (WHERE user_id IS NULL) AS DOUBLE) FROM e GROUP BY ALL"""
)
def scoped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user as a scope; events without one are what no scope accounts for."""
    e = day_events(spark, sf_dir)
    totals = e.groupBy("context", "run", "event_type").agg(F.count("*").alias("count"))
    scopes = e.groupBy("context", "run", "event_type", F.col("user_id").alias("scope_id")).agg(F.count("*").alias("count"))
    return reads.scoped(totals, scopes, ["event_type"]).drop("context")
