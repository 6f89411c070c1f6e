"""What a run's events amount to: counts, errors, durations, measures, scopes and kept lines.

An event has run_id, behavior_id, kind, arrival (its place among all events of the run), and where known outcome,
duration_us, scope_id, measures (map<string,double>), stream, seq and line. keys name what a group is, so one job can
aggregate any number of runs of any number of contexts. Sums and counts are combined before they are shuffled; the
caps by order of arrival need the first arrival of each group only, not its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_sig_long

MOST_BEHAVIORS, MOST_CELLS, MOST_MEASURES = 20_000, 200_000, 6
FIRST_LINES, SAMPLED_LINES, LINE_BYTES = 3, 5, 1_024
UNCAPPED = ("test.example", "test.summary", "run.resources")
OVERFLOW = "<behaviors past the cap>"


def bucket(us: Column) -> Column:
    """The histogram bucket of a duration in microseconds: itself below 4, then four to each power of two."""
    top = F.length(F.bin(us)) - 1
    return F.when(us < 4, us.cast("int")).otherwise((top * 4 + F.call_function("shiftright", us, (top - 2)).bitwiseAND(F.lit(3).cast("long"))).cast("int"))


def midpoint(b: Column) -> Column:
    """The middle of a bucket, in microseconds."""
    width = F.pow(F.lit(2.0), (F.floor(b / 4) - 2).cast("double")).cast("long")
    return F.when(b < 4, b.cast("long")).otherwise((F.lit(4) + b % 4) * width + F.floor(width / 2).cast("long"))


def histogram(events: DataFrame, keys: Sequence[str], duration: str = "duration_us") -> DataFrame:
    """keys, bucket, n: the durations of each group by bucket."""
    return events.where(F.col(duration).isNotNull()).groupBy(*keys, bucket(F.col(duration)).alias("bucket")).agg(F.count("*").alias("n"))


def cells(events: DataFrame, keys: Sequence[str], duration: str = "duration_us") -> DataFrame:
    """State of each group's durations that can be added up: a row for each bucket (null: no duration), at most 257 a group,
    with n, errors, total, most and, where events have an arrival, first (the least)."""
    first = [F.min("arrival").alias("first")] if "arrival" in events.columns else []
    failed = F.count_if(F.col("outcome") == "failure") if "outcome" in events.columns else F.lit(0).cast("long")
    return events.groupBy(*keys, bucket(F.col(duration)).alias("bucket")).agg(F.count("*").alias("n"), failed.alias("errors"), F.sum(duration).alias("total"), F.max(duration).alias("most"), *first)


def merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state of all events that states (cells, of any parts of them) stand for, in any order and grouping."""
    first = [F.min("first").alias("first")] if "first" in states.columns else []
    return states.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("total").alias("total"), F.max("most").alias("most"), *first)


def from_cells(state: DataFrame, keys: Sequence[str], at: dict[str, float] | None = None) -> DataFrame:
    """keys, count, errors, duration count, total and max of each group, exact; and quantiles from its histogram, to two digits.

    A quantile is the midpoint of the first bucket at whose end at least ceil(q * count) durations lie, at most the max.
    A group has at most 257 rows, so the window over them is bounded.
    """
    at = {"p50_us": 0.5, "p95_us": 0.95} if at is None else at
    timed = F.when(F.col("bucket").isNotNull(), F.col("n"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = state.withColumn("seen", F.sum(timed).over(upto)).withColumn("all", F.sum(timed).over(whole))
    first = [F.min(F.when(F.col("seen") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("all"))), F.col("bucket"))).alias(f"b_{name}") for name, q in at.items()]
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.sum("errors").alias("errors"), F.sum(timed).alias("duration_count"), F.sum("total").cast("long").alias("duration_total_us"), F.max("most").cast("long").alias("max_us"), *first
    )
    estimates = [round_sig_long(F.least(midpoint(F.col(f"b_{name}")), F.col("max_us")), 2).alias(name) for name in at]
    return sums.select(*keys, "count", "errors", "duration_count", "duration_total_us", *estimates, "max_us")


def quantiles(events: DataFrame, keys: Sequence[str], duration: str = "duration_us", at: dict[str, float] | None = None) -> DataFrame:
    """Duration count, total, quantiles and max of the groups that have durations."""
    return from_cells(cells(events.where(F.col(duration).isNotNull()), keys, duration), keys, at).drop("count", "errors")


def folded(state: DataFrame, most: int = MOST_BEHAVIORS, run: str = "run_id", behavior: str = "behavior_id") -> DataFrame:
    """A state with first and kind, in which behaviors past the first `most` of a run are one without durations, as capped() has it."""
    firsts = state.groupBy(run, behavior, "kind").agg(F.min("first").alias("at"))
    place = F.row_number().over(Window.partitionBy(run).orderBy("at", behavior))
    past = firsts.withColumn("place", place).where((F.col("place") > most) & ~F.col("kind").isin(*UNCAPPED)).select(run, behavior, F.lit(True).alias("past"))
    marked = state.join(past, [run, behavior], "left")
    over = F.coalesce("past", F.lit(False))
    lost = {c: F.when(~over, F.col(c)) for c in ("bucket", "total", "most")}
    out = marked.withColumns(lost | {behavior: F.when(over, F.lit(OVERFLOW)).otherwise(F.col(behavior)), "kind": F.when(over, F.lit("log")).otherwise(F.col("kind"))}).drop("past")
    return merged(out, [run, behavior, "kind"])


def exact_once(stats: DataFrame) -> DataFrame:
    """A single occurrence shows its own duration for every quantile."""
    one = (F.col("count") == 1) & F.col("duration_total_us").isNotNull()
    return stats.withColumns({c: F.when(one, F.col("duration_total_us")).otherwise(F.col(c)) for c in ("p50_us", "p95_us", "max_us")})


def behavior_stats(events: DataFrame, keys: Sequence[str] = ("run_id", "behavior_id")) -> DataFrame:
    """count, errors, and the duration summary of each group."""
    return exact_once(from_cells(cells(events, keys), keys))


def capped(events: DataFrame, most: int = MOST_BEHAVIORS, overflow_id: str = OVERFLOW) -> DataFrame:
    """Events of behaviors past the first `most` of a run fold into one; summary kinds are never folded, but do count.

    Only a row a behavior is ranked. Folded events keep their outcome and line, and lose duration, scope and measures.
    """
    firsts = events.groupBy("run_id", "behavior_id", "kind").agg(F.min("arrival").alias("first"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first", "behavior_id"))
    past = firsts.withColumn("place", place).where((F.col("place") > most) & ~F.col("kind").isin(*UNCAPPED)).select("run_id", "behavior_id", F.lit(True).alias("past"))
    marked = events.join(past, ["run_id", "behavior_id"], "left").withColumn("past", F.coalesce("past", F.lit(False)))
    lost = {c: F.when(~F.col("past"), F.col(c)) for c in ("duration_us", "scope_id", "measures") if c in events.columns}
    return marked.withColumns(lost | {"behavior_id": F.when(F.col("past"), F.lit(overflow_id)).otherwise(F.col("behavior_id")), "kind": F.when(F.col("past"), F.lit("log")).otherwise(F.col("kind"))})


def measure_stats(events: DataFrame, keys: Sequence[str] = ("run_id", "behavior_id"), most: int = MOST_MEASURES) -> DataFrame:
    """count, sum, min and max of each measure by name; the first `most` names of a group by arrival, finite values only."""
    long = events.select(*keys, "arrival", F.posexplode("measures").alias("pos", "name", "value"))
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    stats = long.groupBy(*keys, "name").agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.min(F.struct("arrival", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    return stats.withColumn("place", place).where(F.col("place") <= most).drop("place", "first")


def scope_cells(events: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """run_id, behavior_id, scope_id, count: the first `most` cells of a run by arrival; the rest sum up under a null scope_id."""
    cells = events.where(F.col("scope_id").isNotNull()).groupBy("run_id", "behavior_id", "scope_id").agg(F.count("*").alias("count"), F.min("arrival").alias("first"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first", "behavior_id", "scope_id"))
    kept = cells.withColumn("scope_id", F.when(place <= most, F.col("scope_id")))
    return kept.groupBy("run_id", "behavior_id", "scope_id").agg(F.sum("count").alias("count"))


def scope_sums(events: DataFrame) -> DataFrame:
    """run_id, behavior_id, scope_id, name, sum of each measure in each scope."""
    long = events.where(F.col("scope_id").isNotNull()).select("run_id", "behavior_id", "scope_id", F.explode("measures").alias("name", "value"))
    return long.where(~F.isnan("value")).groupBy("run_id", "behavior_id", "scope_id", "name").agg(F.sum("value").alias("sum"))


def first_occurrence(events: DataFrame, keys: Sequence[str] = ("run_id", "behavior_id")) -> DataFrame:
    """The stream and seq at which each group was first seen."""
    return events.groupBy(*keys).agg(F.min_by(F.struct("stream", "seq"), "arrival").alias("first")).select(*keys, F.col("first.stream").alias("first_stream"), F.col("first.seq").alias("first_seq"))


def exemplars(events: DataFrame, keys: Sequence[str] = ("run_id", "behavior_id"), first: int = FIRST_LINES, sampled: int = SAMPLED_LINES) -> DataFrame:
    """Lines kept as evidence: the first few by arrival, and of the others those of the lowest hash, in order of arrival.

    The sample is fixed by what it holds, so runs agree. Both lists are built by bounded partial minima, not by ranking rows.
    """
    line = F.struct("arrival", "stream", "seq", F.substring("line", 1, LINE_BYTES).alias("line"))
    ordered = F.struct(F.xxhash64("arrival", "seq", "stream").alias("h"), line.alias("row"))
    early = _lowest(events, keys, line, first, "head")
    later = events.join(early.select(*keys, F.element_at("head", -1)["arrival"].alias("upto")), list(keys)).where(F.col("arrival") > F.col("upto"))
    drawn = _lowest(later, keys, ordered, sampled, "drawn")
    both = early.join(drawn, list(keys), "left").withColumn("rows", F.concat("head", F.coalesce(F.array_sort(F.transform("drawn", lambda x: x["row"])), F.array_except("head", "head"))))
    return both.select(*keys, F.posexplode("rows").alias("position", "row")).select(*keys, "position", "row.stream", "row.seq", "row.line")


def _lowest(rows: DataFrame, keys: Sequence[str], value: Column, n: int, name: str) -> DataFrame:
    """The n lowest values of each group: salted first, so a group of any size is ranked in parts."""
    salted = rows.select(*keys, value.alias("v")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(64)))
    part = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("v"))
    few = salted.withColumn("place", part).where(F.col("place") <= n)
    return few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("v")), 1, n).alias(name))


def sources(streams: DataFrame) -> DataFrame:
    """run_id, streams: the set of streams read; a run that recorded none has a null set, not an empty one."""
    return streams.groupBy("run_id").agg(F.when(F.count("*") > 0, F.array_sort(F.collect_set("stream"))).alias("streams"))


def describe(stats: DataFrame) -> DataFrame:
    """One row a run: behaviors, events, top three with shares, errors and their worst, most total time, and those seen once."""
    s = stats.where(F.col("kind") != "run.resources") if "kind" in stats.columns else stats
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "behavior_id", "count"))), 1, 3)
    few = s.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("count"), "behavior_id")))
    head = few.where("place <= 3").groupBy("run_id").agg(F.transform(top, lambda x: F.struct(x["behavior_id"].alias("behavior_id"), x["count"].alias("count"))).alias("top"))
    whole = s.groupBy("run_id").agg(
        F.count("*").alias("behaviors"), F.sum("count").alias("events"), F.sum("errors").alias("error_events"), F.count_if(F.col("errors") > 0).alias("error_behaviors"),
        F.max_by(F.when(F.col("errors") > 0, F.col("behavior_id")), F.when(F.col("errors") > 0, F.struct("errors", "behavior_id"))).alias("worst"),
        F.max_by("behavior_id", F.struct("duration_total_us", "behavior_id")).alias("slowest"), F.count_if(F.col("count") == 1).alias("seen_once"),
    )
    return whole.join(head, "run_id").withColumn("seen_once_share", F.round(F.col("seen_once") / F.col("behaviors"), 2))
