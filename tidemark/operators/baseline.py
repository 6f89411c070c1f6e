"""Which earlier runs a run may be compared with, from what their test summaries say they ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tests(measures: DataFrame) -> DataFrame:
    """run_id, ran, loaded, defined, errors_outside: sums over a run's summaries; a sum with one missing is unknown.

    measures: a row a summary: run_id, examples, expected, defined, errors_outside_of_examples.
    """
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    return measures.groupBy("run_id").agg(
        F.coalesce(whole("examples"), F.lit(0)).cast("long").alias("ran"), whole("expected").cast("long").alias("loaded"), whole("defined").cast("long").alias("defined"), F.coalesce(whole("errors_outside_of_examples"), F.lit(0)).cast("long").alias("errors_outside"),
    )


def stopped(t: str) -> Column:
    return F.coalesce(F.col(f"{t}.ran") < F.col(f"{t}.loaded"), F.lit(False))


def filtered(t: str) -> Column:
    return F.coalesce(F.col(f"{t}.loaded") < F.col(f"{t}.defined"), F.lit(False))


def skipped_existing(t: str) -> Column:
    return (F.col(f"{t}.errors_outside") > 0) | stopped(t) | filtered(t)


def _keys(pairs: DataFrame) -> list[str]:
    """What names a comparison: its case, where runs are judged more than once, and its run."""
    return ["case", "run_id"] if "case" in pairs.columns else ["run_id"]


def judged(pairs: DataFrame, tests: DataFrame, examples: DataFrame) -> DataFrame:
    """pairs (run_id, candidate, maybe case) with reason: null for a comparable candidate.

    A candidate without a summary is out. One that ran everything it had, or all that both this run and any candidate
    ran, is in. Else it had errors, was stopped, or was a subset. Without a summary of its own, a run takes them all.
    examples: distinct (run_id, example).
    """
    keys = _keys(pairs)
    now = tests.select("run_id", F.struct("ran", "loaded", "defined", "errors_outside").alias("now"))
    then = tests.select(F.col("run_id").alias("candidate"), F.struct("ran", "loaded", "defined", "errors_outside").alias("then"))
    rows = pairs.join(now, "run_id", "left").join(then, "candidate", "left")
    ran_all = ~skipped_existing("then") & F.col("then.defined").isNotNull()
    # examples are looked at only where the summaries leave it open, not for all pairs
    open_ = rows.where(F.col("now").isNotNull() & F.col("then").isNotNull() & ~ran_all).select(*keys, "candidate")
    met = pairs.join(open_.select(*keys).distinct(), keys, "left_semi").join(examples, "run_id").join(examples.withColumnRenamed("run_id", "candidate"), ["candidate", "example"]).select(*keys, "candidate", "example")
    existed = met.select(*keys, "example").distinct()
    lacking = open_.join(existed, keys).join(met, [*keys, "candidate", "example"], "left_anti").select(*keys, "candidate").distinct().withColumn("lacks", F.lit(True))
    rows = rows.join(lacking, [*keys, "candidate"], "left")
    why = F.when(F.col("now").isNull(), None).when(F.col("then").isNull(), "no_test_summary").when(ran_all | F.col("lacks").isNull(), None)
    why = why.when(F.col("then.errors_outside") > F.col("now.errors_outside"), "errors_outside_examples").when(stopped("then"), "stopped").otherwise("subset")
    return rows.select(*keys, "candidate", why.alias("reason"))


def incomplete(pairs: DataFrame, tests: DataFrame, examples: DataFrame) -> DataFrame:
    """run_id, n, reason of the runs that did not run what their baseline did. pairs: comparable (run_id, candidate, maybe case) only."""
    keys = _keys(pairs)
    then = pairs.join(tests.withColumnRenamed("run_id", "candidate"), "candidate", "left").groupBy(*keys).agg(F.count("*").alias("n"), F.count("ran").alias("summaries"), F.coalesce(F.max("errors_outside"), F.lit(0)).alias("errors"))
    rows = then.join(tests.select("run_id", F.struct("ran", "loaded", "defined", "errors_outside").alias("now")), "run_id", "left")
    more = F.col("now.errors_outside") > F.col("errors")
    # what a run missed is asked only of one whose own summary says that it left something out
    asked = rows.where(F.col("now").isNotNull() & (more | stopped("now") | filtered("now"))).select(*keys)
    theirs = pairs.join(asked, keys, "left_semi").join(examples.withColumnRenamed("run_id", "candidate"), "candidate").select(*keys, "example").distinct()
    missed = theirs.join(examples, ["run_id", "example"], "left_anti").select(*keys).distinct().withColumn("missed", F.lit(True))
    rows = rows.join(missed, keys, "left")
    why = F.when(F.col("now").isNull(), F.when(F.col("n") == F.col("summaries"), "no_test_summary")).when(F.col("missed").isNull(), None)
    why = why.when(more, "errors_outside_examples").when(stopped("now"), "stopped").when(filtered("now"), "subset")
    return rows.withColumn("reason", why).where("reason is not null").select(*keys, "n", "reason")


def partial(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """run_id, partial: whether every baseline run has a summary that says it skipped examples that exist."""
    then = pairs.join(tests.select(F.col("run_id").alias("candidate"), F.struct("ran", "loaded", "defined", "errors_outside").alias("then")), "candidate", "left")
    return then.groupBy(*_keys(pairs)).agg(F.bool_and(F.coalesce(skipped_existing("then"), F.lit(False))).alias("partial"))
