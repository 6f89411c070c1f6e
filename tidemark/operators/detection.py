"""From the events of many runs to their signals, ranked and grouped: every run against its baseline, in one job.

A comparison is a case: a run and the runs that it is judged by. Usually that is a run with its own baseline, and then a
case has the run's id; outcomes judge later runs by an earlier run's baseline, so a run may stand in many cases.

Stats hold what runs amount to, a row for each behavior of a run. One grouping by (case, behavior) makes a wide row with
the run's own numbers and those of its baseline, at most ten; all rules read that row. What needs more (the rest of the
suite for latency, scopes for owners, examples for partial runs) is looked up for the few behaviors that a rule named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import behavior_ids
from ..functions.numbers import median_of, round_sig
from ..sources.scratch import discard, materialise
from . import aggregate, baseline, compare, detect, rules
from .ranges import beside

RUNNER = "file:rspec-events"
INSIDE = r"^(example|request):"
SETUP = "setup"


@dataclass(frozen=True)
class Stats:
    """What runs amount to.

    runs: run_id, context, started (their order in a context), usable, streams (array; null where unknown), past_cap.
    facts: a row for each behavior of a run. cells: its occurrences and measures within each scope; scope is
    example:<id>, request:<id>, between or teardown. What is before the first example is in no scope.
    """

    runs: DataFrame
    facts: DataFrame
    cells: DataFrame


def scope_of(scope: Column) -> Column:
    """The scope of an event as cells name it: an example by its behavior's id, a request by one of its endpoint."""
    name = F.regexp_replace(scope, "^[a-z]+:", "")
    inside = F.when(scope.startswith("example:"), F.concat(F.lit("example:"), behavior_ids(F.lit("test.example"), name)))
    inside = inside.when(scope.startswith("request:"), F.concat(F.lit("request:"), behavior_ids(F.lit("scope.request"), name)))
    return inside.when(scope.isin("phase:between", "phase:teardown"), name)


def stats_of(events: DataFrame, runs: DataFrame, streams: DataFrame | None = None, most_behaviors: int = aggregate.MOST_BEHAVIORS, most_cells: int = aggregate.MOST_CELLS) -> Stats:
    """Stats of events (interpret.interpret) of runs (run_id, context, started, usable). streams: run_id, stream of each that was read."""
    keys = ["run_id", "behavior_id"]
    scoped = events.withColumn("scope_id", scope_of(F.col("scope")))
    e = aggregate.capped(scoped, most_behaviors).withColumn("template", F.when(F.col("behavior_id") == aggregate.OVERFLOW, aggregate.OVERFLOW).otherwise(F.col("template")))
    counts = e.groupBy(*keys).agg(
        F.first("kind").alias("kind"), F.first("template").alias("template"), F.count("*").alias("count"), F.count_if(F.col("outcome") == "failure").alias("errors"),
        F.count("duration_us").alias("timed"), F.sum("duration_us").alias("total_us"), F.min_by(F.struct("stream", "seq"), "arrival").alias("first"),
    )
    sums = aggregate.measure_stats(e).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "sum"))).alias("measures"))
    cells = aggregate.scope_cells(e, most_cells)
    inside = aggregate.scope_sums(e).groupBy(*keys, "scope_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "sum"))).alias("sums"))
    cells = cells.join(inside, [*keys, "scope_id"], "left").withColumnsRenamed({"behavior_id": "behavior", "scope_id": "scope"})
    facts = counts.join(sums, keys, "left").withColumnRenamed("behavior_id", "behavior")
    return assemble(runs, facts.select("run_id", "behavior", "kind", "template", "count", "errors", "timed", "total_us", "measures", F.col("first.stream").alias("stream"), F.col("first.seq").alias("seq")), cells, streams)


def assemble(runs: DataFrame, counts: DataFrame, cells: DataFrame, streams: DataFrame | None = None) -> Stats:
    """Stats of counts (run_id, behavior, kind, template, count, errors, timed, total_us, measures, stream, seq) and cells
    (run_id, behavior, scope, count, sums; a null scope holds what a cap left without one)."""
    keys = ["run_id", "behavior"]
    named = cells.where("scope is not null")
    per = cells.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("scope").isNull(), F.col("count"))), F.lit(0)).alias("unattributed"), F.coalesce(F.sum(F.when(F.col("scope").isNotNull(), F.col("count"))), F.lit(0)).alias("scoped"),
        F.count("scope").alias("scopes"), F.max("scope").alias("one_scope"), F.count_if(F.col("scope").rlike(INSIDE)).alias("units"), F.coalesce(F.sum(F.col("sums")["queries"]), F.lit(0.0)).alias("scoped_queries"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = counts.join(per, keys, "left").withColumns({c: zero(c) for c in ("unattributed", "scoped", "scopes", "units")})
    rows = rows.withColumn("unscoped", F.col("count") - F.col("scoped") - F.col("unattributed"))
    rows = rows.withColumn("sole", F.when((F.col("unattributed") == 0) & (F.col("unscoped") == 0) & (F.col("scopes") == 1), F.col("one_scope")))
    # queries that examples made, in runs where every query is known to have a scope or to be outside of all
    counted = ~F.exists(F.array(*map(F.lit, detect.UNCOUNTED)), lambda p: F.startswith(F.col("template"), p))
    queries = rows.where((F.col("kind") == "db.query") & counted).select(*keys)
    by_example = named.join(queries, keys).where(F.col("scope").startswith("example:")).groupBy("run_id", F.substring_index("scope", ":", -1).alias("behavior")).agg(F.sum("count").cast("double").alias("made"))
    thrown = named.join(rows.where("kind = 'exception'").select(*keys, "template"), keys).where(F.col("scope").startswith("example:"))
    thrown = thrown.groupBy("run_id", F.substring_index("scope", ":", -1).alias("example")).agg(F.array_sort(F.collect_set(F.struct("behavior", "template"))).alias("reasons")).withColumnRenamed("example", "behavior")
    per_run = rows.groupBy("run_id").agg(
        zero(F.sum(F.when(F.col("behavior") == aggregate.OVERFLOW, F.col("count")))).alias("past_cap"), F.count_if(F.col("kind") == "test.example").alias("size"),
        F.count_if((F.col("kind") == "db.query") & (F.col("unattributed") > 0)).alias("loose"),
    )
    facts = rows.join(by_example, keys, "left").join(thrown, keys, "left").join(per_run, "run_id")
    made = F.when((F.col("past_cap") == 0) & (F.col("loose") == 0), F.coalesce("made", F.lit(0.0)))
    of_request = F.col("measures")["queries"]
    facts = facts.select(
        "run_id", "behavior", "kind", "template", "count", "errors", "stream", "seq", "measures", "unattributed", "unscoped", "scopes", "units", "sole", "size",
        F.when(F.col("kind") == "test.example", made).when(F.col("kind") == "http.request", of_request).alias("queries"), F.greatest(of_request - F.coalesce("scoped_queries", F.lit(0.0)), F.lit(0.0)).alias("loose_queries"),
        (F.col("total_us") / 1000.0).alias("total_ms"), F.when(F.col("timed") > 0, F.col("total_us") / 1000.0 / F.col("timed")).alias("ms"), F.coalesce("reasons", F.array().cast("array<struct<behavior:string,template:string>>")).alias("reasons"),
    )
    known = runs.join(per_run.select("run_id", "past_cap"), "run_id", "left").withColumn("past_cap", zero("past_cap"))
    read = aggregate.sources(streams) if streams is not None else None
    known = known.join(read, "run_id", "left") if read is not None else known.withColumn("streams", F.lit(None).cast("array<string>"))
    return Stats(materialise(known, "runs"), materialise(facts, "facts"), materialise(named, "cells"))


def own_cases(stats: Stats) -> tuple[DataFrame, DataFrame]:
    """(cases, pairs) of every usable run with the ten before it: cases has case, run_id; pairs case, run_id, candidate, ord."""
    runs = compare.numbered(stats.runs.where("usable").withColumn("run", F.struct("started", "run_id")), "run")
    at = runs.select("context", F.col("ord").alias("base_ord"), F.col("run_id").alias("candidate"))
    pairs = compare.baselines(runs).join(runs.select("context", "ord", "run_id"), ["context", "ord"]).join(at, ["context", "base_ord"])
    return runs.select(F.col("run_id").alias("case"), "run_id"), pairs.select(F.col("run_id").alias("case"), "run_id", "candidate", F.col("base_ord").alias("ord"))


def eligible(stats: Stats, cases: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bases, skipped, known) of cases: bases has case, base, ord; skipped case, run_id, candidate, reason; known a row a case.

    known: case, run_id, n, incomplete (why the run left out what its baseline ran, or null), partial, reporter, and of
    the run and its baseline the caps passed and the streams read.
    """
    summaries = stats.facts.where("kind = 'test.summary'")
    names = {"examples": "examples", "expected": "expected", "defined": "defined", "errors_outside_of_examples": "errors_outside_of_examples"}
    tests = baseline.tests(summaries.select("run_id", *[F.col("measures")[m].alias(c) for c, m in names.items()]))
    examples = stats.facts.where("kind = 'test.example'").select("run_id", F.col("behavior").alias("example"))
    tests, examples = materialise(tests, "tests"), materialise(examples, "examples")
    verdicts = materialise(baseline.judged(pairs.select("case", "run_id", "candidate"), tests, examples), "verdicts")
    good = verdicts.where("reason is null").select("case", "run_id", "candidate")
    bases = good.join(pairs.select("case", "candidate", "ord"), ["case", "candidate"]).select("case", F.col("candidate").alias("base"), "ord")
    why = baseline.incomplete(good, tests, examples).select("case", F.col("reason").alias("incomplete"))
    part = baseline.partial(good, tests).drop("run_id")
    of = stats.runs.select("run_id", "past_cap", "streams")
    then = bases.join(of.withColumnRenamed("run_id", "base"), "base").groupBy("case").agg(F.count("*").alias("n"), F.collect_list("past_cap").alias("past_then"), F.collect_list(F.struct("streams")).alias("read_then"))
    now = of.select("run_id", F.col("past_cap").alias("past_now"), F.col("streams").alias("read_now"))
    reporter = examples.select("run_id").distinct().withColumn("reporter", F.lit(True))
    known = cases.join(now, "run_id").join(reporter, "run_id", "left").join(then, "case").join(why, "case", "left").join(part, "case", "left")
    known = known.withColumns({"reporter": F.coalesce("reporter", F.lit(False)), "partial": F.coalesce("partial", F.lit(False))})
    bases, known = materialise(bases, "bases"), materialise(known, "cases")
    discard(tests, examples)
    return bases, verdicts.where("reason is not null"), known


NUMBERS = ["count", "errors", "ms", "total_ms", "queries", "loose_queries", "unattributed", "unscoped", "units", "sole", "size", "seq", "reasons", "measures"]


def wide(stats: Stats, bases: DataFrame, known: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A row for each behavior of a case: now (its numbers in the run, or null), then (those in the runs of its baseline that
    have it), and what it is: kind, template, stream and loose (no scope), as the run or else the newest of the others has it.

    wanted: case, behavior of the only ones that are asked for; then no others are read, however many the runs have.
    """
    keep = ["behavior", F.struct("kind", "template", "stream", (F.col("scopes") == 0).alias("loose")).alias("what"), F.col("stream").alias("on"), F.struct(*NUMBERS).alias("numbers")]
    of = known.select("case", "run_id", F.lit(1 << 30).alias("ord")).union(bases.select("case", "base", F.col("ord").cast("int")))
    if wanted is None:
        # facts are shuffled once, by behavior; each meets its cases, a small table, where it then is
        rows = stats.facts.repartition("behavior").join(of, "run_id")
    else:
        rows = stats.facts.join(of.join(wanted, "case"), ["run_id", "behavior"])
    is_now = F.col("ord") == 1 << 30
    met = rows.select("case", *keep, "ord").groupBy("case", "behavior").agg(
        F.max_by("what", "ord").alias("what"), F.collect_set("on").alias("streams"), F.first(F.when(is_now, F.col("numbers")), ignorenulls=True).alias("now"), F.collect_list(F.when(~is_now, F.col("numbers"))).alias("then")
    )
    rows = met.join(known, "case").select("*", "what.*").drop("what")
    return rows.withColumn("class", _class())


def _class() -> Column:
    """What rules a behavior takes; null for none."""
    outside = (F.col("kind") == "exception") & F.col("loose") & (F.col("stream") == RUNNER)
    found = F.when(F.col("behavior") == aggregate.OVERFLOW, None).when(F.col("kind").isin(*detect.SILENT), None)
    found = found.when(F.col("kind") == "test.example", "example").when(F.col("kind") == "http.request", "request").when(F.col("kind") == "db.query", "sql").when(outside, "outside")
    return found.when(F.col("stream") == "stderr", "stderr").when(F.col("reporter"), None).otherwise("output")


def _found(kind: str | Column, measure: str, current: Column, values: Column, confidence: Column, when: Column, n: Column | None = None, median: Column | None = None, failures: Column | None = None, exception: Column | None = None, edge=lambda c: c) -> Column:
    """A signal, or null; values are the baseline's."""
    text, number = lambda c, t: (F.lit(None) if c is None else c).cast(t), "double"
    return F.when(
        when,
        F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(measure).alias("measure"), current.cast(number).alias("current"), (F.col("n") if n is None else n).cast("int").alias("baseline_runs"),
            F.size(values).alias("present_in"), edge(median_of(values) if median is None else median).cast(number).alias("median"), edge(F.array_min(values)).cast(number).alias("min"), edge(F.array_max(values)).cast(number).alias("max"),
            text(failures, "int").alias("failures"), text(exception, "string").alias("exception"), confidence.cast(number).alias("confidence"),
        ),
    )


def _judged(rows: DataFrame) -> DataFrame:
    """The signals that a behavior's own numbers give; latency before what the rest of the run may say against it."""
    # the values and the rules' answers are columns, so that each is worked out once a row, however often it is read
    of = lambda f: F.transform("then", lambda x: x[f].cast("double"))
    rows = rows.where("class is not null").withColumns({"_count": of("count")} | {f"_{f}": F.filter(of(f), lambda v: v.isNotNull()) for f in ("queries", "ms")})
    in_all = F.col("now").isNotNull() & (F.size("then") == F.col("n"))
    rows = rows.withColumns({
        "_by_count": F.when(in_all & (F.col("class") != "example"), rules.frequency(F.col("_count"), F.col("now.count").cast("double"))),
        "_by_queries": F.when(in_all & F.col("class").isin("example", "request") & (F.size("_queries") == F.col("n")), rules.frequency(F.col("_queries"), F.col("now.queries"))),
        "_slow": F.when(F.col("incomplete").isNull() & F.col("now.ms").isNotNull(), rules.latency(F.col("_ms"), F.col("now.ms"))),
    })
    then = held = lambda f: F.col(f"_{f}")
    now, n, kind_of, none = F.col("now").isNotNull(), F.col("n"), F.col("class"), F.array().cast("array<double>")
    seen = rules.presence(now, F.size("then"), n)
    # a stream that one side did not read, or a cap that it passed, accounts for what it lacks
    unread = lambda read, s: read.isNotNull() & ~F.coalesce(F.array_contains(read, s), F.lit(True))
    off_now = F.exists("streams", lambda s: unread(F.col("read_now"), s))
    off_then = F.exists("streams", lambda s: F.forall("read_then", lambda r: unread(r["streams"], s)))
    cut = ~F.col("kind").isin(*aggregate.UNCAPPED)
    gone = (seen["kind"] == "disappeared") & (off_now | (cut & (F.col("past_now") > 0)))
    new = (seen["kind"] == "new") & (off_then | (cut & F.forall("past_then", lambda p: p > 0)))
    out = [_found(seen["kind"], "count", F.coalesce("now.count", F.lit(0)), then("count"), seen["confidence"], seen.isNotNull() & ~gone & ~new)]
    by_count, by_queries = F.col("_by_count"), F.col("_by_queries")
    out.append(_found("frequency", "count", F.col("now.count"), then("count"), by_count["confidence"], by_count.isNotNull()))
    out.append(_found("frequency", "queries", F.col("now.queries"), held("queries"), by_queries["confidence"], by_queries.isNotNull()))
    failed = F.filter("then", lambda x: x["errors"] > 0)
    mine = F.col("now.reasons")
    alike = F.exists(failed, lambda x: F.arrays_overlap(x["reasons"], mine) | ((F.size(x["reasons"]) == 0) & (F.size(mine) == 0)))
    wrong = rules.error(F.col("now.errors"), F.size(failed), F.size("then"), F.coalesce(alike, F.lit(False)))
    named = F.nullif(F.array_join(F.transform(mine, lambda r: r["template"]), ", "), F.lit(""))
    out.append(_found("error", "failed", F.col("now.errors"), none, wrong["confidence"], now & (kind_of == "example") & wrong.isNotNull(), n=F.size("then"), failures=F.size(failed), exception=named))
    slow = F.col("_slow")
    three = lambda c: round_sig(c.cast("double"), 3)
    out.append(_found("latency", "duration_ms", three(F.col("now.ms")), held("ms"), slow["confidence"], slow.isNotNull(), n=F.size(held("ms")), edge=three))
    rows = rows.withColumn("s", F.explode(F.array_compact(F.array(*out)))).drop("_count", "_queries", "_ms", "_by_count", "_by_queries", "_slow")
    rows = rows.withColumn("s", F.when(F.col("s.kind") == "error", F.col("s").withField("present_in", F.col("s.baseline_runs"))).otherwise(F.col("s")))
    return rows.withColumnRenamed("kind", "behavior_kind").select("*", "s.*").drop("s")


def _unstalled(found: DataFrame, rows: DataFrame, stats: Stats, bases: DataFrame, known: DataFrame) -> DataFrame:
    """found without latency that the run as a whole, the examples beside, or several other examples share."""
    slow = found.where("kind = 'latency'").select("case", "behavior", F.col("behavior_kind").alias("kind"), "class", F.col("now.ms").alias("ms"), F.col("now.total_ms").alias("total_ms"), F.transform("then", lambda x: x["ms"]).alias("mss"), F.transform("then", lambda x: x["total_ms"]).alias("totals"))
    some = slow.select("case").distinct()
    # the run's whole time in this kind of work; for examples the suite's own duration, where it gave one
    total = stats.facts.where("total_ms is not null").groupBy("run_id", "kind").agg(F.sum("total_ms").alias("ms"))
    suite = total.where("kind = 'test.summary' and ms > 0").select("run_id", F.col("ms").alias("suite"))
    total = total.join(suite, "run_id", "left").withColumn("ms", F.when(F.col("kind") == "test.example", F.coalesce("suite", "ms")).otherwise(F.col("ms"))).select("run_id", "kind", "ms")
    own = total.join(known.join(some, "case", "left_semi").select("case", "run_id"), "run_id").select("case", "kind", F.col("ms").alias("window_now"), F.lit(None).cast("double").alias("base"))
    base = total.join(bases.join(some, "case", "left_semi").select("case", F.col("base").alias("run_id")), "run_id").select("case", "kind", F.lit(None).cast("double").alias("window_now"), F.col("ms").alias("base"))
    window = own.unionByName(base).groupBy("case", "kind").agg(F.max("window_now").alias("window_now"), F.filter(F.collect_list("base"), lambda v: v > 0).alias("window"))
    # examples in the order they ran, and how much slower each was; the few largest are enough to veto
    timed = rows.where("class = 'example' and now is not null").join(some, "case", "left_semi").select("case", "behavior", F.col("now.seq").alias("seq"), (F.col("now.ms") - median_of(F.filter(F.transform("then", lambda x: x["ms"]), lambda v: v.isNotNull()))).alias("slow"))
    near = beside(timed, ["case"], ["seq", "behavior"], {"slow": "slow"}).select("case", "behavior", F.greatest("before_slow", "after_slow").alias("neighbour"))
    most = compare.largest(timed.where("slow > 0"), ["case"], "slow", rules.COHORT_PEERS + 1, "slowdowns")
    checked = slow.join(window, ["case", "kind"], "left").join(near, ["case", "behavior"], "left").join(most, "case", "left")
    example = F.col("class") == "example"
    held = lambda c: F.filter(c, lambda v: v.isNotNull())
    excess = F.col("total_ms") - median_of(held("totals"))
    rule = rules.latency(held("mss"), F.col("ms"), F.when(example, F.col("neighbour")), F.when(example, F.col("slowdowns")), (F.coalesce("window", F.array().cast("array<double>")), F.coalesce("window_now", F.lit(0.0)), excess))
    stalled = checked.where(rule.isNull()).select("case", "behavior", F.lit("latency").alias("kind"))
    return found.join(stalled, ["case", "behavior", "kind"], "left_anti")


def _case_cells(some: DataFrame, stats: Stats, bases: DataFrame, known: DataFrame) -> DataFrame:
    """The cells of behaviors (case, behavior) in the runs of their cases, with is_now."""
    runs = known.select("case", "run_id", F.lit(True).alias("is_now")).union(bases.select("case", F.col("base").alias("run_id"), F.lit(False).alias("is_now")))
    return some.join(runs, "case").join(stats.cells, ["run_id", "behavior"])


def _spoken_for(found: DataFrame, stats: Stats, bases: DataFrame, known: DataFrame) -> DataFrame:
    """found without what partial runs explain: in an incomplete run, what is gone or changed elsewhere than within examples
    that it ran; where the whole baseline was partial, what is new within examples that it never ran."""
    gone, new = F.col("incomplete").isNotNull() & F.col("kind").isin("disappeared", "frequency"), F.col("partial") & (F.col("kind") == "new")
    some = found.where((gone | new) & (F.col("class") != "example")).select("case", "behavior").distinct()
    ran = stats.facts.where("kind = 'test.example'").select("run_id", F.concat(F.lit("example:"), "behavior").alias("scope"))
    cells = _case_cells(some, stats, bases, known)
    asked = cells.select("case", "scope").distinct()  # a case's examples are many, those that these cells name few
    ran_now = asked.join(known.select("case", "run_id"), "case").join(ran, ["run_id", "scope"], "left_semi").select("case", "scope", F.lit(True).alias("ran_now"))
    ran_then = asked.join(bases.select("case", F.col("base").alias("run_id")), "case").join(ran, ["run_id", "scope"], "left_semi").select("case", "scope").distinct().withColumn("ran_then", F.lit(True))
    cells = cells.join(ran_now, ["case", "scope"], "left").join(ran_then, ["case", "scope"], "left")
    example = F.col("scope").startswith("example:")
    inside = cells.groupBy("case", "behavior").agg(F.bool_and(example & F.col("ran_now").isNotNull()).alias("all_ran"), F.bool_and(example & F.col("ran_then").isNull()).alias("none_ran"))
    rows = found.join(inside, ["case", "behavior"], "left")
    every = F.concat("then", F.filter(F.array("now"), lambda x: x.isNotNull()))
    whole = F.forall(every, lambda x: (x["unattributed"] == 0) & (x["unscoped"] == 0))
    an_example = F.col("class") == "example"
    kept_gone = F.when(an_example, F.col("now").isNotNull()).otherwise(whole & F.coalesce("all_ran", F.lit(True)))
    drop_new = F.when(an_example, F.size("then") == 0).otherwise(whole & F.coalesce("none_ran", F.lit(True)))
    return rows.where(~(gone & ~kept_gone) & ~(new & drop_new)).drop("all_ran", "none_ran")


def _incomplete(rows: DataFrame) -> DataFrame:
    """The signals of runs that left out what their baseline ran, on what shows it; and of runs past the cap on behaviors."""
    count = lambda x: x["count"].cast("double")
    sure = rules.incomplete(F.col("n"))["confidence"]
    zeros = lambda values: F.concat(values, F.array_repeat(F.lit(0.0), F.col("n").cast("int") - F.size(values)))
    flat = lambda signal: rows.withColumn("s", signal).where("s is not null").withColumnRenamed("kind", "behavior_kind").select("*", "s.*").drop("s")
    # errors outside examples, more of them than in any run before
    then = zeros(F.transform("then", count))
    more = (F.col("incomplete") == "errors_outside_examples") & (F.col("class") == "outside") & F.col("now").isNotNull() & (F.col("now.count") > F.array_max(then))
    errors = flat(_found("incomplete", "count", F.col("now.count"), then, sure, more))
    # else the summary: whether there was one, what it ran, or how many errors it counted
    measure = lambda name: F.filter(F.transform("then", lambda x: x["measures"][name]), lambda v: v.isNotNull())
    now = lambda name: F.coalesce(F.col("now.measures")[name], F.lit(0.0))
    summary, why = F.col("kind") == "test.summary", F.col("incomplete")
    told = F.coalesce(
        _found("incomplete", "count", F.coalesce("now.count", F.lit(0)), F.transform("then", count), sure, summary & (why == "no_test_summary")),
        _found("incomplete", "examples", now("examples"), measure("examples"), sure, summary & why.isin("stopped", "subset")),
        _found("incomplete", "errors_outside_of_examples", now("errors_outside_of_examples"), measure("errors_outside_of_examples"), sure, summary & (why == "errors_outside_examples")),
    )
    one = Window.partitionBy("case").orderBy(F.col("now").isNull(), "behavior")
    summaries = flat(told).withColumn("p", F.row_number().over(one)).where("p = 1").drop("p").join(errors.select("case").distinct(), "case", "left_anti")
    past = _found("incomplete", "events_past_cap", F.col("past_now"), F.transform("past_then", lambda p: p.cast("double")), sure, F.lit(True)).withField("present_in", F.size(F.filter("past_then", lambda p: p > 0)))
    cut = flat(F.when((F.col("behavior") == aggregate.OVERFLOW) & (F.col("past_now") > 0) & F.col("now").isNotNull(), past))
    return errors.unionByName(summaries).unionByName(cut)


def _owned(found: DataFrame, stats: Stats, bases: DataFrame, known: DataFrame) -> DataFrame:
    """found with scope, scope_current, scope_baseline (the one scope whose own value left its median) and sole (the one that
    all occurrences are in)."""
    keys = ["case", "behavior", "measure"]
    asked = found.where((F.col("class") != "example") & (F.col("kind") != "incomplete") & F.col("measure").isin("count", "queries"))
    every = F.concat(F.filter(F.array("now"), lambda x: x.isNotNull()), "then")
    asked = asked.where(F.forall(every, lambda x: x["unattributed"] == 0))
    cells = _case_cells(asked.select(*keys, "n").distinct(), stats, bases, known)
    value = F.when(F.col("measure") == "count", F.col("count").cast("double")).otherwise(F.coalesce(F.col("sums")[F.col("measure")], F.lit(0.0)))
    per = cells.groupBy(*keys, "n", "scope").agg(F.max(F.when(F.col("is_now"), value)).alias("own"), F.collect_list(F.when(~F.col("is_now"), value)).alias("vals"))
    # a test run has a phase before its first example, which no cell names
    loose = lambda x: F.when(F.col("measure") == "count", x["unscoped"].cast("double")).otherwise(F.coalesce(x["loose_queries"], F.lit(0.0)))
    setup = asked.where(F.col("reporter") & F.col("class").isin("sql", "request")).select(*keys, "n", F.lit(SETUP).alias("scope"), F.when(F.col("now").isNotNull(), loose(F.col("now"))).alias("own"), F.transform("then", loose).alias("vals"))
    filled = F.concat("vals", F.array_repeat(F.lit(0.0), F.col("n").cast("int") - F.size("vals")))
    moved = per.unionByName(setup).withColumns({"own": F.coalesce("own", F.lit(0.0)), "middle": median_of(filled)}).where("own <> middle")
    one = moved.groupBy(*keys).agg(F.count("*").alias("k"), F.max(F.struct("scope", "own", "middle")).alias("o")).where("k = 1")
    sole = F.when((F.size(F.array_distinct(F.transform(every, lambda x: F.coalesce(x["sole"], F.lit(""))))) == 1) & (F.col("class") != "example"), every[0]["sole"])
    rows = found.join(one.select(*keys, F.col("o.scope").alias("scope"), F.col("o.own").alias("scope_current"), F.col("o.middle").alias("scope_baseline")), keys, "left")
    return rows.withColumn("sole", sole)


def _tiered(found: DataFrame) -> DataFrame:
    """found with tier, group_key, moved, example and file: what it is worth, and what it is grouped under."""
    example, kind, stderr = F.col("class") == "example", F.col("kind"), F.col("class") == "stderr"
    # a count that moved only as the suite's size did: more than one unit of work has it, and its rate says nothing
    sizes = F.transform("then", lambda x: x["size"])
    rates = F.transform("then", lambda x: x["count"] / x["size"])
    known = (F.col("now.size") > 0) & F.forall(sizes, lambda s: s > 0) & F.exists(sizes, lambda s: s != F.col("now.size"))
    by_size = (kind == "frequency") & (F.col("measure") == "count") & known & (F.col("now.units") >= 2) & F.when(known, rules.frequency(rates, F.col("now.count") / F.col("now.size"))).isNull()
    place = F.when(kind == "incomplete", None).when(example, F.concat(F.lit("example:"), "behavior")).otherwise(F.coalesce("scope", F.when(~stderr, F.col("sole"))))
    around = place.isNotNull() & ~place.rlike(INSIDE)
    demoted = F.coalesce(by_size, F.lit(False)) | around
    tier = compare.tier(kind, on_request=F.col("class") == "request", outside=F.col("class") == "outside", stderr=stderr, demoted=(kind != "incomplete") & demoted, timed=F.col("class").isin("example", "request"))
    moved = example & kind.isin("new", "disappeared")
    rows = found.withColumns({"tier": tier, "place_of": place, "moved": moved, "group_key": detect.group_key(kind, F.col("behavior"), place, F.lit(None), F.col("template"), stderr)})
    return rows.withColumns({"example": F.when(place.startswith("example:"), F.substring_index("place_of", ":", -1)), "file": F.when(moved & F.col("template").contains(" # "), F.substring_index("template", " # ", 1))})


OUT = ["context", "run", "run_id", "behavior", "behavior_kind", "template", "kind", "measure", "current", "baseline_runs", "present_in", "median", "min", "max", "failures", "exception", "scope", "scope_current", "scope_baseline", "confidence", "tier", "group_key", "group_rank", "place", "head"]


def _unowned(stats: Stats, bases: DataFrame, known: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The signals of cases, before it is asked what they are worth; written."""
    rows = materialise(wide(stats, bases, known, wanted), "wide")
    judged, shown = materialise(_judged(rows), "judged"), materialise(_incomplete(rows), "incomplete")
    found = _spoken_for(_unstalled(judged, rows, stats, bases, known), stats, bases, known)
    # the error that left a run incomplete is named once, as that
    found = found.join(shown.where("measure <> 'events_past_cap'").select("case", "behavior"), ["case", "behavior"], "left_anti")
    found = materialise(found.unionByName(shown), "found")
    discard(rows, judged, shown)
    return found


def _asked(stats: Stats, raised: DataFrame, met: DataFrame, bases: DataFrame, known: DataFrame) -> DataFrame:
    """case, behavior of all that the rules read to judge raised signals (run_id, behavior, kind) again in cases (met: case,
    run_id): these behaviors; what may show that a run is incomplete; and where an example's latency is asked for, the
    other examples, which may speak against it."""
    of = stats.facts.select("run_id", "behavior", "kind", "stream")
    own = met.join(raised.select("run_id", "behavior").distinct(), "run_id").select("case", "behavior")
    runs = known.select("case", "run_id").union(bases.select("case", F.col("base").alias("run_id")))
    few = of.where((F.col("kind") == "test.summary") | ((F.col("kind") == "exception") & (F.col("stream") == RUNNER)) | (F.col("behavior") == aggregate.OVERFLOW))
    slow = raised.where("kind = 'latency'").select("run_id", "behavior").join(of.where("kind = 'test.example'").select("behavior").distinct(), "behavior", "left_semi").select("run_id").distinct()
    timed = runs.join(met.join(slow, "run_id", "left_semi").select("case"), "case", "left_semi")
    return own.union(runs.join(few, "run_id").select("case", "behavior")).union(timed.join(of.where("kind = 'test.example'"), "run_id").select("case", "behavior")).distinct()


def signals(stats: Stats, cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """The signals of cases (own_cases), unranked: case, run_id, behavior, kind, measure and their numbers, scopes, tier and group_key."""
    bases, _, known = eligible(stats, cases, pairs)
    found = _unowned(stats, bases, known)
    out = materialise(detect.collapse(_tiered(_owned(found, stats, bases, known)), ["case"]), "signals")
    discard(found, bases, known)
    return out


def detect_runs(stats: Stats) -> DataFrame:
    """Every usable run's signals against its own baseline, ranked: groups in order, the head of each first."""
    cases, pairs = own_cases(stats)
    found = signals(stats, cases, pairs).join(stats.runs.select("run_id", "context"), "run_id").withColumn("run", F.col("run_id"))
    return compare.ranked(found).select(*OUT)


def votes(stats: Stats, raised: DataFrame) -> DataFrame:
    """What later runs say of signals raised (run_id, behavior, kind, measure): a row for each signal and later run that has
    a vote: run_id, behavior, kind, measure, later, ord, firing, and reproducible (whether its own run still raises it).

    A later run is judged by the baseline of the signal's own run. It has no vote if it left out what that baseline ran,
    or passed its cap on behaviors. raised may have a column refused, of runs whose comparison was refused: no votes either.
    """
    runs = compare.numbered(stats.runs.where("usable").withColumn("run", F.struct("started", "run_id")), "run")
    cases, pairs = own_cases(stats)
    bases, _, _ = eligible(stats, cases.join(raised.select("run_id").distinct(), "run_id", "left_semi"), pairs)
    origin = raised.select("run_id").distinct().join(runs.select("run_id", "context", "ord"), "run_id")
    later = runs.select("context", F.col("run_id").alias("later"), F.col("ord").alias("later_ord"))
    met = origin.join(later, "context").where("later_ord >= ord").withColumn("case", F.concat_ws("\x1f", "run_id", "later"))
    asked = met.select("case", F.col("later").alias("run_id"))
    again = met.select("case", "later", F.col("run_id").alias("origin")).join(bases.select(F.col("case").alias("origin"), F.col("base").alias("candidate"), "ord"), "origin").select("case", F.col("later").alias("run_id"), "candidate", "ord")
    rebased, _, known = eligible(stats, asked, again)
    speaks = known.where("incomplete is null and past_now = 0").select("case")
    wanted = materialise(_asked(stats, raised, met, rebased, known), "wanted")
    fired = _unowned(stats, rebased, known, wanted).select("case", "behavior", "kind", "measure").distinct().withColumn("fired", F.lit(True))
    keys = ["behavior", "kind", "measure"]
    both = raised.select("run_id", *keys).distinct().join(met, "run_id").join(fired, ["case", *keys], "left").withColumn("firing", F.coalesce("fired", F.lit(False)))
    own = both.where("later = run_id").select("run_id", *keys, F.col("firing").alias("reproducible"))
    after = both.where("later <> run_id").join(speaks, "case", "left_semi").select("run_id", *keys, "later", F.col("later_ord").alias("ord"), "firing")
    return own.join(after, ["run_id", *keys], "left")
