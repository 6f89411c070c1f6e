"""What became of signals, derived from later runs and never stored; and what stored runs are kept for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..sources.scratch import materialise
from . import detection, rules

# How much of a context is kept unless asked otherwise.
KEEP_STATS_RUNS, KEEP_EVIDENCE_RUNS, LIVE_RUNS, IDLE_DAYS = 200, 20, 21, 90


def outcomes(judged: DataFrame, keys: list[str]) -> DataFrame:
    """keys and what later runs say of each signal: status, resolved_in, recurred_in, recurrences.

    judged: a row for each signal and later run that has a vote, with ord and firing. A signal is resolved in the first
    later run where it is silent, recurred in the first after that where it fires again; steps from silent to firing
    count. Without a vote it is open.
    """
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = judged.withColumn("before", F.lag("firing").over(w)).withColumn("last", F.last("firing").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("quiet", F.min(F.when(~F.col("firing"), F.col("ord"))).over(Window.partitionBy(*keys)))
    out = rows.groupBy(*keys).agg(
        F.min("quiet").alias("resolved_in"), F.min(F.when(F.col("firing") & (F.col("ord") > F.col("quiet")), F.col("ord"))).alias("recurred_in"),
        F.count_if(F.col("firing") & ~F.coalesce("before", F.lit(True))).alias("recurrences"), F.first("last").alias("firing"),
    )
    return out.withColumn("status", status(F.lit(True), F.col("firing"), F.col("resolved_in"))).drop("firing")


SIGNAL = ["run_id", "behavior", "kind", "measure"]


def judge(stats: detection.Stats, raised: DataFrame) -> DataFrame:
    """What became of signals of any kind: run_id, behavior, kind, measure, status, resolved_in, recurred_in (runs), recurrences.

    raised: run_id, behavior, kind, measure. Later runs are judged by the baseline of the signal's own run; a signal that
    its own run no longer raises is unknown, one without a vote open.
    """
    votes = materialise(detection.votes(stats, raised), "votes")
    said = outcomes(votes.where("later is not null"), SIGNAL)
    name = votes.where("later is not null").select("run_id", "ord", "later").distinct()
    named = lambda c: name.select("run_id", F.col("ord").alias(c), F.col("later").alias(f"{c}_run"))
    rows = votes.select(*SIGNAL, "reproducible").distinct().join(said, SIGNAL, "left")
    rows = rows.join(named("resolved_in"), ["run_id", "resolved_in"], "left").join(named("recurred_in"), ["run_id", "recurred_in"], "left")
    verdict = F.when(~F.col("reproducible"), "unknown").otherwise(F.coalesce("status", F.lit("open")))
    return rows.select(*SIGNAL, verdict.alias("status"), F.col("resolved_in_run").alias("resolved_in"), F.col("recurred_in_run").alias("recurred_in"), F.coalesce("recurrences", F.lit(0)).alias("recurrences"))


def status(reproducible, firing, resolved_in):
    """unknown where detection can't be repeated; recurred where it fires after a silence; then resolved or open."""
    return F.when(~reproducible, "unknown").when(firing & resolved_in.isNotNull(), "recurred").when(resolved_in.isNotNull(), "resolved").otherwise("open")


def still_open(signals: DataFrame, outcome: DataFrame, raised_now: DataFrame, judged_groups: DataFrame, keys: list[str]) -> DataFrame:
    """Earlier signals that still hold: open, in no group someone has judged, not raised again now; oldest first, one a key."""
    held = signals.join(outcome.where(F.col("status").isin("open", "recurred")), [*keys, "run"], "left_semi")
    held = held.join(raised_now, keys, "left_anti").join(judged_groups, ["run", "group_key"], "left_anti")
    return held.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("run"))).where("place = 1").drop("place")


def examined(feedback: DataFrame, resolved: DataFrame) -> DataFrame:
    """signal_id of the signals that someone looked into before they were resolved. resolved: signal_id, until_ms (null: not yet)."""
    asked = feedback.where(F.col("kind").isin("investigated", "evidence_requested", "acked"))
    return asked.join(resolved, "signal_id").where("until_ms is null or at_ms <= until_ms").select("signal_id").distinct()


def judgement(feedback: DataFrame) -> DataFrame:
    """signal_id, judgement: wrong if anyone said so, else acting. It holds whenever it was made, before a fix or after."""
    level = F.when(F.col("kind") == "dismissed", 2).when(F.col("kind") == "acked", 1)
    return feedback.where(level.isNotNull()).groupBy("signal_id").agg(F.max(level).alias("level")).select("signal_id", F.when(F.col("level") == 2, "wrong").otherwise("acting").alias("judgement"))


def scorecard(signals: DataFrame) -> DataFrame:
    """A row for each kind and one for all (kind null): how many signals were raised and judged, and what became of the latter.

    A signal without a verdict (status unknown) counts as raised only: we can't tell, so no rate may hold it.
    signals: kind, status, examined and dismissed (booleans).
    """
    judged, said = F.col("status") != "unknown", lambda s: F.col("status") == s
    out = signals.rollup("kind").agg(
        F.count("*").alias("raised"), F.count_if(judged).alias("judged"), F.count_if(~judged).alias("unjudged"), F.count_if(judged & F.col("examined")).alias("examined"), F.count_if(judged & F.col("dismissed")).alias("dismissed"),
        F.count_if(said("resolved")).alias("resolved"), F.count_if(said("resolved") & ~F.col("examined")).alias("resolved_unexamined"), F.count_if(said("recurred")).alias("recurred"), F.count_if(said("open")).alias("open"),
    )
    return out.withColumn("examined_rate", rate(F.col("examined"), F.col("judged"))).withColumn("unexamined_rate", rate(F.col("resolved_unexamined"), F.col("resolved")))


def frequency_votes(found: DataFrame, aggregates: DataFrame, runs: DataFrame, behavior: list[str], value: str = "count") -> DataFrame:
    """context, run, behavior columns, ord, firing: whether each later run of a context repeats a change of frequency.

    found: compare.frequency(); a later run is judged by the numbers of the signal's own baseline, so no run is compared again.
    """
    own = found.select("context", "run", *behavior, "min", "max", "median", "exact").join(runs.select("context", "run", F.col("ord").alias("own_ord")), ["context", "run"])
    later = runs.select("context", F.col("run").alias("later"), "ord")
    asked = own.join(later, "context").where("ord > own_ord")  # a row for each vote
    then = aggregates.select("context", F.col("run").alias("later"), *behavior, F.col(value).cast("double").alias("then"))
    rows = asked.join(then, ["context", "later", *behavior], "left")
    out = (F.col("then") < F.col("min")) | (F.col("then") > F.col("max"))
    far = F.abs(F.col("then") - F.col("median")) > rules.VARYING_WIDTHS * (F.col("max") - F.col("min"))
    return rows.select("context", "run", *behavior, "ord", F.coalesce(out & (F.col("exact") | far), F.lit(False)).alias("firing"))


def retention_plan(runs: DataFrame, stats_runs: int = KEEP_STATS_RUNS, evidence_runs: int = KEEP_EVIDENCE_RUNS, idle_before: str | None = None) -> DataFrame:
    """(context, run, action) of the runs to prune: stats drops all but the run's row, evidence its captured lines.

    runs: context, run, started (order), usable, live, has_stats, has_evidence. The newest LIVE_RUNS usable runs of a
    context keep their statistics, since the next run compares with them; a context idle since before idle_before keeps none.
    """
    newest = Window.partitionBy("context").orderBy(F.desc("started"), F.desc("run"))
    rows = runs.withColumn("place", F.row_number().over(newest)).withColumn("usable_place", F.sum(F.col("usable").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    idle = F.max("started").over(Window.partitionBy("context")) < F.lit(idle_before).cast("timestamp") if idle_before else F.lit(False)
    protected = F.col("usable") & (F.col("usable_place") <= LIVE_RUNS)
    stats = F.col("has_stats") & (idle | ((F.col("place") > stats_runs) & ~protected))
    evidence = F.col("has_evidence") & (F.col("place") > evidence_runs)
    action = F.when(F.col("live"), None).when(stats, "stats").when(evidence, "evidence")
    return rows.withColumn("action", action).where("action is not null").select("context", "run", "started", "action")


def context_rollup(runs: DataFrame) -> DataFrame:
    """Each context's runs, how many keep statistics and evidence, and its first and last run and time."""
    return runs.groupBy("context").agg(
        F.count("*").alias("runs"), F.count_if("has_stats").alias("with_stats"), F.count_if("has_evidence").alias("with_evidence"),
        F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.min("started").alias("first_started"), F.max("started").alias("last_started"),
    )
