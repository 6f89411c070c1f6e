"""From aggregates to ranked signals: what class a behavior is of, which rules it takes, who owns a change, how they group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import median_of
from . import compare

#: Behaviors of these kinds raise no signal of their own.
SILENT = ("test.summary", "run.resources")
UNCOUNTED = ("TRANSACTION ", "SCHEMA ")


def behavior_class(kind: Column, template: Column, stream: Column, reporter: Column, in_example: Column) -> Column:
    """example, request, sql, stderr, output or outside; null for what raises nothing.

    With a test reporter in the run, log lines count on stderr only, and exceptions only outside examples.
    """
    counted = ~F.exists(F.array(*map(F.lit, UNCOUNTED)), lambda p: F.startswith(template, p))
    found = F.when(kind.isin(*SILENT), None).when(kind == "test.example", "example").when(kind == "http.request", "request")
    found = found.when(kind == "db.query", F.when(counted, F.lit("sql"))).when((kind == "exception") & reporter, F.when(~in_example, F.lit("outside")))
    return found.when(stream == "stderr", "stderr").when(reporter, None).otherwise("output")


def example_queries(scopes: DataFrame) -> DataFrame:
    """context, run, scope_id, queries: countable queries by the example that made them. scopes: with kind, template, count."""
    counted = ~F.exists(F.array(*map(F.lit, UNCOUNTED)), lambda p: F.startswith(F.col("template"), p))
    return scopes.where((F.col("kind") == "db.query") & counted & F.col("scope_id").isNotNull()).groupBy("context", "run", "scope_id").agg(F.sum("count").alias("queries"))


def dispatch(counts: DataFrame, classes: DataFrame, runs: DataFrame, requests: DataFrame, queries: DataFrame, gaps: DataFrame, errors: DataFrame) -> DataFrame:
    """context, run, behavior, class, kind, measure, current, confidence: what each behavior's class lets its numbers say.

    All classes may be new or gone. Requests take their count and their queries, examples their errors and the queries
    attributed to them, the others their count. An example's queries say nothing in a run where gaps names it or one of
    its baseline: queries were cut there, or stayed without a scope.

    counts: context, run, behavior, count; classes: context, behavior, class; requests: as counts, with queries; queries:
    example_queries() with behavior for scope_id; gaps: context, run; errors: compare.errors() of behavior.
    """
    known = classes.where("class is not null")
    of = lambda rows, *names: rows.join(known.where(F.col("class").isin(*names)) if names else known, ["context", "behavior"])
    said = lambda rows, measure: rows.select("context", "run", "behavior", "class", "kind", F.lit(measure).alias("measure"), "current", "confidence")
    counted = compare.wide(of(counts, "request", "sql", "stderr", "output", "outside").drop("class"), runs, ["behavior"])
    seen = compare.wide(of(counts).drop("class"), runs, ["behavior"])
    made = of(counts, "example").join(queries, ["context", "run", "behavior"], "left").withColumn("queries", F.coalesce("queries", F.lit(0)))
    loose = compare.wide(gaps.distinct().withColumn("one", F.lit(1)), runs, [], "one").select("context", "run")
    by_example = compare.frequency(compare.wide(made, runs, ["behavior"], "queries"), ["behavior"]).join(loose, ["context", "run"], "left_anti")
    by_request = compare.frequency(compare.wide(of(requests, "request").drop("class"), runs, ["behavior"], "queries"), ["behavior"])
    failed = of(errors, "example").select("context", "run", "behavior", "class", F.lit("error").alias("kind"), F.lit("errors").alias("measure"), F.col("current").cast("double").alias("current"), "confidence")
    out = said(of(compare.presence(seen, ["behavior"])), "count").unionByName(said(of(compare.frequency(counted, ["behavior"])), "count"))
    return out.unionByName(said(of(by_example), "queries")).unionByName(said(of(by_request), "queries")).unionByName(failed)


def owners(scopes: DataFrame, runs: DataFrame, behavior: Sequence[str], scope: str = "scope_id", value: str = "count") -> DataFrame:
    """context, run, behavior columns, owner, owner_current, owner_median: where exactly one scope's own value left its median.

    A scope that a baseline run lacks counts as 0 there. scopes: context, run, behavior columns, scope, value; a row with
    a null scope (what could not be attributed) leaves its behavior without an owner in that run.
    """
    known = compare.wide(scopes.where(F.col(scope).isNotNull()), runs, [*behavior, scope], value).where("n > 0")
    filled = F.concat(F.array_repeat(F.lit(0.0), F.col("n") - F.col("present_in")), F.col("vals"))
    moved = known.withColumn("own", F.coalesce("current", F.lit(0.0))).withColumn("middle", median_of(filled)).where("own <> middle")
    one = moved.groupBy("context", "run", *behavior).agg(F.count("*").alias("k"), F.max(F.struct(scope, "own", "middle")).alias("s")).where("k = 1")
    loose = scopes.where(F.col(scope).isNull()).select("context", "run", *behavior).distinct()
    return one.join(loose, ["context", "run", *behavior], "left_anti").select("context", "run", *behavior, F.col(f"s.{scope}").alias("owner"), F.col("s.own").alias("owner_current"), F.col("s.middle").alias("owner_median"))


def sole_scope(scopes: DataFrame, runs: DataFrame, behavior: Sequence[str], scope: str = "scope_id") -> DataFrame:
    """context, run, behavior columns, sole: the one scope that a behavior has in a run and in all of its baseline."""
    known = compare.wide(scopes.withColumn("one", F.lit(1)), runs, [*behavior, scope], "one")
    return known.groupBy("context", "run", *behavior).agg(F.count("*").alias("k"), F.max(scope).alias("sole"), F.count(scope).alias("named")).where("k = 1 and named = 1").drop("k", "named")


def group_key(kind: Column, behavior: Column, owner: Column, sole: Column, template: Column, stderr: Column) -> Column:
    """What a signal is grouped under: an incomplete run, a scope, a start of stderr lines, or itself. The digit orders kinds."""
    found = F.when(kind == "incomplete", "0").when(owner.isNotNull(), F.concat(F.lit("1:"), owner))
    return found.when(stderr, F.concat(F.lit("3:"), F.substring(template, 1, 60))).when(sole.isNotNull(), F.concat(F.lit("1:"), sole)).otherwise(F.concat(F.lit("4:"), behavior))


def collapse(found: DataFrame, keys: Sequence[str] = ("context", "run")) -> DataFrame:
    """found with group_key: two or more examples of one file that came or went together are one group, with all of their scope.

    found: keys, kind, behavior, group_key, moved (an example that came or went), file (its own), and example (the example
    that a signal is about or belongs to, if any).
    """
    together = Window.partitionBy(*keys, "kind", "file")
    moved = found.where("moved and file is not null").select(*keys, "kind", "file", F.col("behavior").alias("example")).withColumn("alike", F.count("*").over(together)).where("alike > 1")
    key = F.concat(F.lit("2:"), "kind", F.lit(":"), "file")
    return found.join(moved.select(*keys, "example", key.alias("of_file")), [*keys, "example"], "left").withColumn("group_key", F.coalesce("of_file", "group_key")).drop("of_file")


def partial_filters(found: DataFrame, incomplete: DataFrame, ran: DataFrame, partial: DataFrame) -> DataFrame:
    """Signals that a part of a run can't speak for are left out.

    In an incomplete run: latency, and what is gone or changed in scopes other than examples that ran. Where all of the
    baseline was partial: what is new within examples that it never ran. found has scopes (array of example ids);
    incomplete: context, run; ran: context, run, examples (array); partial: context, run, unrun (array).
    """
    rows = found.join(incomplete.withColumn("part", F.lit(True)), ["context", "run"], "left").join(ran, ["context", "run"], "left").join(partial, ["context", "run"], "left")
    inside = (F.size("scopes") > 0) & F.forall("scopes", lambda s: F.array_contains("examples", s))
    unrun = (F.size("scopes") > 0) & F.coalesce(F.forall("scopes", lambda s: F.array_contains("unrun", s)), F.lit(False))
    drop = (F.coalesce("part", F.lit(False)) & ((F.col("kind") == "latency") | (F.col("kind").isin("disappeared", "frequency") & ~F.coalesce(inside, F.lit(False))))) | ((F.col("kind") == "new") & unrun)
    return rows.where(~drop).drop("part", "examples", "unrun")


def explain(signals: DataFrame, aggregates: DataFrame, runs: DataFrame, exemplars: DataFrame) -> DataFrame:
    """A document a signal: its values by run of the baseline, and its kept lines from the first run that has any.

    signals: context, run, behavior; aggregates: context, run, behavior, count; exemplars: context, run, behavior, position, line.
    """
    ord_of = runs.select("context", "run", "ord")
    base = compare.baselines(runs).join(ord_of.withColumnsRenamed({"run": "base_run", "ord": "base_ord"}), ["context", "base_ord"]).join(ord_of, ["context", "ord"])
    then = signals.select("context", "run", "behavior").join(base.select("context", "run", "base_run", "base_ord"), ["context", "run"]).join(aggregates.select("context", F.col("run").alias("base_run"), "behavior", "count"), ["context", "base_run", "behavior"], "left")
    values = then.groupBy("context", "run", "behavior").agg(F.array_sort(F.collect_list(F.struct("base_ord", "base_run", F.coalesce("count", F.lit(0)).alias("count")))).alias("baseline"))
    either = then.select("context", "run", "behavior", F.col("base_run").alias("kept_run"), "base_ord").union(signals.join(ord_of, ["context", "run"]).select("context", "run", "behavior", F.col("run").alias("kept_run"), (-F.col("ord")).alias("base_ord")))
    lines = either.join(exemplars.withColumnRenamed("run", "kept_run"), ["context", "kept_run", "behavior"])
    first = F.dense_rank().over(Window.partitionBy("context", "run", "behavior").orderBy("base_ord"))
    kept = lines.withColumn("r", first).where("r = 1").groupBy("context", "run", "behavior").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]).alias("evidence"))
    return signals.join(values, ["context", "run", "behavior"], "left").join(kept, ["context", "run", "behavior"], "left")
