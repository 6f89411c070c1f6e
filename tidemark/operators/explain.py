"""Why a signal was raised: its values run by run, the scopes that moved, what the runs used, and what is grouped with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import median_of
from . import detection

#: Scopes that an explanation shows, those that moved most first.
MOST_SCOPES = 10


def explained(stats: detection.Stats, found: DataFrame, exemplars: DataFrame | None = None, most_scopes: int = MOST_SCOPES) -> DataFrame:
    """found (of detect_runs) with baseline, scopes, moved_scopes, resources, members and, given exemplars (run_id, behavior,
    position, line), evidence.

    baseline: the count in each run compared with, in order, 0 where it lacks the behavior. scopes: own count and the
    baseline's median (0 where a run lacks it) of those scopes in which they differ, moved_scopes their number. resources:
    each measure of the run's own usage and its median before. members: all signals of the group, the head first.
    evidence: the lines kept by the run, else by the latest run of its baseline that has any.
    """
    cases, pairs = detection.own_cases(stats)
    bases, _, _ = detection.eligible(stats, cases, pairs)
    raised = found.select("run_id", "behavior").distinct()
    then = raised.join(bases.select(F.col("case").alias("run_id"), "base", "ord"), "run_id")
    n = bases.groupBy(F.col("case").alias("run_id")).agg(F.count("*").cast("int").alias("n"))
    counts = stats.facts.select(F.col("run_id").alias("base"), "behavior", "count")
    one = F.struct("ord", F.col("base").alias("run"), F.coalesce("count", F.lit(0)).alias("count"))
    values = then.join(counts, ["base", "behavior"], "left").groupBy("run_id", "behavior").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["run"].alias("run"), x["count"].alias("count"))).alias("baseline"))
    # own and earlier counts of each scope of the behavior
    cells = stats.cells.select("run_id", "behavior", "scope", "count")
    own = cells.join(raised, ["run_id", "behavior"], "left_semi").select("run_id", "behavior", "scope", F.col("count").alias("own"), F.lit(None).cast("double").alias("before"))
    before = then.join(cells.withColumnRenamed("run_id", "base"), ["base", "behavior"]).select("run_id", "behavior", "scope", F.lit(None).cast("long").alias("own"), F.col("count").cast("double").alias("before"))
    per = own.unionByName(before).groupBy("run_id", "behavior", "scope").agg(F.coalesce(F.max("own"), F.lit(0)).alias("own"), F.collect_list("before").alias("vals")).join(n, "run_id")
    per = per.withColumn("usual", median_of(F.concat("vals", F.array_repeat(F.lit(0.0), F.col("n") - F.size("vals"))))).where("own <> usual")
    moved = F.array_sort(F.collect_list(F.struct((-F.abs(F.col("own") - F.col("usual"))).alias("by"), "scope", "own", "usual")))
    scopes = per.groupBy("run_id", "behavior").agg(F.count("*").alias("moved_scopes"), F.transform(F.slice(moved, 1, most_scopes), lambda x: x.dropFields("by")).alias("scopes"))
    used = stats.facts.where("kind = 'run.resources'").select("run_id", F.explode("measures").alias("measure", "value"))
    usual = used.withColumnRenamed("run_id", "base").join(bases.select(F.col("case").alias("run_id"), "base"), "base").groupBy("run_id", "measure").agg(F.median("value").alias("usual"))
    resources = used.join(usual, ["run_id", "measure"], "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("measure", "value", "usual"))).alias("resources"))
    members = found.groupBy("run_id", "group_rank").agg(F.array_sort(F.collect_list(F.struct("place", "behavior", "kind", "measure"))).alias("members"))
    out = found.join(values, ["run_id", "behavior"], "left").join(scopes, ["run_id", "behavior"], "left").join(resources, "run_id", "left").join(members, ["run_id", "group_rank"])
    out = out.withColumn("moved_scopes", F.coalesce("moved_scopes", F.lit(0)))
    if exemplars is None:
        return out
    near = raised.withColumns({"kept_in": F.col("run_id"), "ord": F.lit(1 << 30)}).union(then.select("run_id", "behavior", F.col("base").alias("kept_in"), "ord"))
    kept = exemplars.groupBy(F.col("run_id").alias("kept_in"), "behavior").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]).alias("lines"))
    lines = near.join(kept, ["kept_in", "behavior"]).groupBy("run_id", "behavior").agg(F.max_by("lines", "ord").alias("evidence"))
    return out.join(lines, ["run_id", "behavior"], "left")


def document(rows: DataFrame) -> DataFrame:
    """A JSON document a signal."""
    return rows.select("run_id", "behavior", "kind", "measure", F.to_json(F.struct(*[c for c in rows.columns if c not in ("context", "run")])).alias("document"))
