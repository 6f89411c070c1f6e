"""Every run against its baseline, for all runs of all contexts in one job.

A baseline is the (at most ten) comparable runs before a run in its context. Instead of joining runs with runs, each
behavior's rows are put in the order of its runs, and a frame of eleven of them holds a run's own row and its baseline:
each aggregate row is shuffled once, and no array is above eleven values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rules
from .ranges import beside

LIMIT = 10


def numbered(runs: DataFrame, order: str, context: str = "context") -> DataFrame:
    """runs with ord, their place in their context from 1, n, the size of their baseline, and last, the context's last ord.

    runs holds usable ones only: finished, not interrupted, statistics kept.
    """
    w = Window.partitionBy(context)
    out = runs.withColumn("ord", F.row_number().over(w.orderBy(order)))
    return out.withColumn("n", F.least(F.col("ord") - 1, F.lit(LIMIT))).withColumn("last", F.count("*").over(w).cast("int"))


def baselines(runs: DataFrame) -> DataFrame:
    """(context, ord, base_ord) of numbered runs: the ten before, by a row frame."""
    rows = runs.select("context", "ord", F.collect_list("ord").over(Window.partitionBy("context").orderBy("ord").rowsBetween(-LIMIT, -1)).alias("base"))
    return rows.select("context", "ord", F.explode("base").alias("base_ord"))


def wide(aggregates: DataFrame, runs: DataFrame, behavior: Sequence[str], value: str = "count") -> DataFrame:
    """context, ord, run, n, behavior columns, current, now, vals, present_in of every behavior seen in a run or its baseline.

    aggregates: context, run, behavior columns (a row each) and a double value. runs: numbered(). vals are the values of the
    baseline runs that have it, sorted; current is null where the run has none.
    """
    rows = aggregates.join(runs.select("context", "run", "ord", "last"), ["context", "run"]).select("context", "ord", "last", *behavior, F.col(value).cast("double").alias("v"))
    by_run = Window.partitionBy("context", *behavior).orderBy("ord")
    seen = rows.withColumns({"near": F.collect_list(F.struct("ord", "v")).over(by_run.rangeBetween(-LIMIT, 0)), "until": F.lead("ord").over(by_run) - 1})
    # a row stands for its own run, and for those after it that lack the behavior, as long as it is in their baseline
    until = F.least(F.coalesce("until", "last"), F.col("ord") + LIMIT, "last")
    at = seen.withColumn("at", F.explode(F.sequence("ord", until)))
    before = F.filter("near", lambda x: (x["ord"] < F.col("at")) & (x["ord"] >= F.col("at") - LIMIT) & x["v"].isNotNull())
    grouped = at.select("context", F.col("at").alias("ord"), *behavior, F.when(F.col("at") == F.col("ord"), F.col("v")).alias("current"), F.array_sort(F.transform(before, lambda x: x["v"])).alias("vals"))
    out = grouped.join(runs.select("context", "ord", "run", "n"), ["context", "ord"])
    return out.select("context", "ord", "run", "n", *behavior, "current", F.col("current").isNotNull().alias("now"), "vals", F.size("vals").alias("present_in"))


def presence(compared: DataFrame, behavior: Sequence[str]) -> DataFrame:
    """The new and the disappeared behaviors: kind, current and the median of the runs that had it."""
    from ..functions.numbers import median_of

    found = compared.withColumn("s", rules.presence(F.col("now"), F.col("present_in"), F.col("n"))).where("s is not null")
    return found.select("context", "run", *behavior, "s.kind", F.coalesce("current", F.lit(0.0)).alias("current"), "n", "present_in", median_of(F.col("vals")).alias("median"), "s.confidence")


def frequency(compared: DataFrame, behavior: Sequence[str]) -> DataFrame:
    """Measures outside what every baseline run had; silent where one lacks it, and for what is absent now."""
    found = compared.where("now and present_in = n").withColumn("s", rules.frequency(F.col("vals"), F.col("current"))).where("s is not null")
    return found.select("context", "run", *behavior, F.lit("frequency").alias("kind"), "current", "n", "s.exact", "s.median", "s.min", "s.max", "s.confidence")


def errors(stats: DataFrame, runs: DataFrame, behavior: Sequence[str]) -> DataFrame:
    """Failures now against the baseline runs that ran it, with none known. stats: count, errors and reasons (array) of each.

    A baseline failure is known if it shares a reason with this one, or neither has any.
    """
    rows = stats.join(runs.select("context", "run", "ord", "last"), ["context", "run"])
    cols = ["context", "ord", *behavior]
    own = rows.select(*cols, "errors", "reasons", F.lit(None).cast("struct<failed:boolean,reasons:array<string>>").alias("base"))
    ahead = rows.where("ord < last").withColumn("ord", F.explode(F.sequence(F.col("ord") + 1, F.least(F.col("ord") + LIMIT, "last"))))
    base = ahead.select(*cols, F.lit(None).cast("long").alias("errors"), F.lit(None).cast("array<string>").alias("reasons"), F.struct((F.col("errors") > 0).alias("failed"), "reasons").alias("base"))
    met = own.unionByName(base).groupBy(*cols).agg(F.max("errors").alias("errors"), F.max("reasons").alias("reasons"), F.collect_list("base").alias("base"))
    mine = F.coalesce("reasons", F.array().cast("array<string>"))
    alike = F.exists("base", lambda b: b["failed"] & (F.arrays_overlap(F.coalesce(b["reasons"], F.array().cast("array<string>")), mine) | ((F.size(mine) == 0) & (F.coalesce(F.size(b["reasons"]), F.lit(0)) <= 0))))
    failures = F.size(F.filter("base", lambda b: b["failed"]))
    found = met.where("errors > 0").withColumns({"ran": F.size("base"), "failures": failures}).withColumn("s", rules.error(F.col("errors"), F.col("failures"), F.col("ran"), F.coalesce(alike, F.lit(False)))).where("s is not null")
    return found.join(runs.select("context", "ord", "run"), ["context", "ord"]).select("context", "run", *behavior, F.lit("error").alias("kind"), F.col("errors").cast("double").alias("current"), F.col("ran").alias("n"), "failures", "s.confidence")


def latency(compared: DataFrame, behavior: Sequence[str], neighbour: str | None = None, slowdowns: str | None = None, window: tuple[str, str, str] | None = None) -> DataFrame:
    """Means of milliseconds far above those of the runs that timed it; the vetoes by columns of compared, where given."""
    veto = {"neighbour": F.col(neighbour) if neighbour else None, "slowdowns": F.col(slowdowns) if slowdowns else None, "window": tuple(map(F.col, window)) if window else None}
    found = compared.where("now").withColumn("s", rules.latency(F.col("vals"), F.col("current"), **veto)).where("s is not null")
    return found.select("context", "run", *behavior, F.lit("latency").alias("kind"), "current", F.size("vals").alias("n"), "s.median", "s.confidence")


def slowdowns(compared: DataFrame, order: str) -> DataFrame:
    """compared (of timed examples, with first-seen order) with neighbour and slowdowns: current less the baseline's median.

    A run's examples are ordered by one window for the neighbours; the cohort is the array of the run's slowdowns.
    """
    from ..functions.numbers import median_of

    rows = compared.withColumn("slow", F.when(F.col("now") & (F.size("vals") > 0), F.col("current") - median_of(F.col("vals"))))
    rows = beside(rows, ["context", "run"], [order], {"slow": "slow"}).withColumn("neighbour", F.greatest("before_slow", "after_slow")).drop("before_slow", "after_slow")
    # only the largest can veto: one more of them than the rule asks for is enough to know
    cohort = largest(rows.where("slow > 0"), ["context", "run"], "slow", rules.COHORT_PEERS + 1, "slowdowns")
    return rows.join(cohort, ["context", "run"], "left")


def largest(rows: DataFrame, keys: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """keys and the n largest values of each group, largest first; a group of any size is ranked in parts."""
    salted = rows.select(*keys, value, (F.monotonically_increasing_id() % 64).alias("salt"))  # any salt gives the same values
    few = salted.withColumn("p", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(F.desc(value)))).where(F.col("p") <= n)
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(value), asc=False), 1, n).alias(name))


def tier(kind, on_request=None, outside=None, stderr=None, demoted=None, timed=None):
    """1 for errors, incomplete runs and new failures outside examples, to 5 for what setup or the suite's size explains."""
    no = F.lit(False)
    on_request, outside, stderr, demoted, timed = (no if c is None else c for c in (on_request, outside, stderr, demoted, timed))
    found = F.when(demoted, 5).when(kind.isin("error", "incomplete") | ((kind == "new") & outside), 1)
    found = found.when(((kind == "frequency") & on_request) | ((kind == "new") & stderr) | ((kind == "latency") & timed), 2)
    return found.when(kind == "frequency", 3).otherwise(4)


def ranked(signals: DataFrame) -> DataFrame:
    """signals (context, run, behavior, measure, kind, confidence, tier, group_key, moved) with group_rank, place and head.

    Precedence: tier, confidence (highest first), kind, behavior, measure. A group's head is its first, those that moved
    before the others; groups stand in the order of their heads. Run by run, so windows are as large as a run's signals.
    """
    order = ["tier", F.desc("confidence"), rules.kind_order(F.col("kind")), "behavior", "measure"]
    in_group = Window.partitionBy("context", "run", "group_key").orderBy(F.desc("moved"), *order)
    rows = signals.withColumn("place", F.row_number().over(in_group))
    heads = rows.where("place = 1").withColumn("group_rank", F.row_number().over(Window.partitionBy("context", "run").orderBy(*order)))
    return rows.join(heads.select("context", "run", "group_key", "group_rank"), ["context", "run", "group_key"]).withColumn("head", F.col("place") == 1)


def demoted(frequencies: DataFrame, counts: DataFrame, examples: DataFrame, runs: DataFrame, behavior: Sequence[str]) -> DataFrame:
    """frequencies with suite_size: the suite's size moved, the behavior is in two or more examples, and its rate per example is silent.

    counts: context, run, behavior columns, count, in_examples. examples: context, run, examples.
    """
    per = counts.join(examples, ["context", "run"]).withColumn("per", F.col("count").cast("double") / F.col("examples"))
    moved = frequency(wide(per, runs, behavior, "per"), behavior).select("context", "run", *behavior, F.lit(True).alias("rate_moved"))
    sizes = wide(examples.withColumn("suite", F.lit("suite")), runs, ["suite"], "examples")
    sizes = sizes.select("context", "run", (F.size("vals") > 0).alias("known"), ((F.col("current") < F.array_min("vals")) | (F.col("current") > F.array_max("vals"))).alias("size_moved"))
    out = frequencies.join(sizes, ["context", "run"], "left").join(counts.select("context", "run", *behavior, "in_examples"), ["context", "run", *behavior], "left").join(moved, ["context", "run", *behavior], "left")
    why = F.coalesce("size_moved", F.lit(False)) & (F.coalesce("in_examples", F.lit(0)) >= 2) & ~F.coalesce("rate_moved", F.lit(False))
    return out.withColumn("suite_size", why).drop("known", "size_moved", "in_examples", "rate_moved")


def refused(signals: DataFrame, most: int = 1_000) -> DataFrame:
    """Signals of the runs that have at most so many; a flood is counted, not kept."""
    sizes = signals.groupBy("context", "run").agg(F.count("*").alias("found"))
    return signals.join(sizes.where(F.col("found") <= most).select("context", "run"), ["context", "run"], "left_semi")
