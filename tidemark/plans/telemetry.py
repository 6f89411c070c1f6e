"""Queries over the events table: a run is a day, a behavior a tuple of columns, and days follow each other in one context.

Each has DuckDB SQL written another way: the SQL joins runs with runs, where the library sends aggregates ahead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import median_of, share
from ..operators import aggregate, compare, outcomes, reads, rules
from ..registry import query
from ..sources.scratch import materialise

BEHAVIOR = ["event_type", "user_id"]


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.lit("events").alias("context"), F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_id").alias("arrival"), "event_type", "user_id", "value", "props",
        F.floor(F.col("value") * 1000).cast("long").alias("duration_us"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"),
    )


def day_runs(events: DataFrame) -> DataFrame:
    return compare.numbered(events.select("context", "run").distinct(), "run")


# The start of the SQL below: events by day, days in order, and a macro-like comparison of counts.
DAYS = """
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS run, event_id, event_type, user_id, value, props,
                  CAST(floor(value * 1000) AS BIGINT) AS us, event_type = 'error' AS failed FROM events),
r AS (SELECT run, row_number() OVER (ORDER BY run) AS ord FROM (SELECT DISTINCT run FROM e))
"""


def compared_sql(value: str, keys: str = "event_type, user_id", where: str = "TRUE") -> str:
    return f"""{DAYS},
a AS (SELECT r.ord, {keys}, CAST({value} AS DOUBLE) AS v FROM e JOIN r USING (run) WHERE {where} GROUP BY ALL),
w AS (SELECT c.run, c.ord, least(c.ord - 1, 10) AS n, {keys},
             max(CASE WHEN a.ord = c.ord THEN v END) AS cur,
             count(CASE WHEN a.ord < c.ord THEN v END) AS present_in,
             min(CASE WHEN a.ord < c.ord THEN v END) AS lo, max(CASE WHEN a.ord < c.ord THEN v END) AS hi,
             median(CASE WHEN a.ord < c.ord THEN v END) AS med
      FROM r c JOIN a ON a.ord BETWEEN c.ord - 10 AND c.ord GROUP BY c.run, c.ord, {keys})
"""


@query(
    DAYS
    + """SELECT run, event_type, count(*) AS count, count(*) FILTER (WHERE failed) AS errors,
                CAST(sum(us) AS BIGINT) AS total_us, max(us) AS max_us FROM e GROUP BY run, event_type"""
)
def run_behavior_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = aggregate.behavior_stats(day_events(spark, sf_dir), ["run", "event_type"])
    return stats.select("run", "event_type", "count", "errors", F.col("duration_total_us").alias("total_us"), "max_us")


HISTOGRAM = (
    DAYS
    + """, b AS (SELECT run, event_type, us, CASE WHEN us < 4 THEN us ELSE (length(bin(us)) - 1) * 4 + ((us >> (length(bin(us)) - 3)) & 3) END AS bucket FROM e)
"""
)


QUANTILES = """, o AS (SELECT *, row_number() OVER (PARTITION BY run, event_type ORDER BY bucket) AS place, count(*) OVER (PARTITION BY run, event_type) AS n FROM b),
s AS (SELECT run, event_type, count(*) AS duration_count, CAST(sum(us) AS BIGINT) AS duration_total_us, max(us) AS max_us,
             max(CASE WHEN place = greatest(1, ceil(0.5 * n)) THEN bucket END) AS b50, max(CASE WHEN place = greatest(1, ceil(0.95 * n)) THEN bucket END) AS b95 FROM o GROUP BY run, event_type),
m AS (SELECT *, least(max_us, CASE WHEN b50 < 4 THEN b50 ELSE (4 + b50 % 4) * (1::BIGINT << (b50 // 4 - 2)) + (1::BIGINT << (b50 // 4 - 2)) // 2 END) AS q50,
                least(max_us, CASE WHEN b95 < 4 THEN b95 ELSE (4 + b95 % 4) * (1::BIGINT << (b95 // 4 - 2)) + (1::BIGINT << (b95 // 4 - 2)) // 2 END) AS q95 FROM s)
SELECT run, event_type, duration_count, duration_total_us,
       CAST(CASE WHEN q50 < 100 THEN q50 ELSE (q50 + CAST(10 ** (length(q50::VARCHAR) - 2) AS BIGINT) // 2) // CAST(10 ** (length(q50::VARCHAR) - 2) AS BIGINT) * CAST(10 ** (length(q50::VARCHAR) - 2) AS BIGINT) END AS BIGINT) AS p50_us,
       CAST(CASE WHEN q95 < 100 THEN q95 ELSE (q95 + CAST(10 ** (length(q95::VARCHAR) - 2) AS BIGINT) // 2) // CAST(10 ** (length(q95::VARCHAR) - 2) AS BIGINT) * CAST(10 ** (length(q95::VARCHAR) - 2) AS BIGINT) END AS BIGINT) AS p95_us, max_us FROM m"""


@query(HISTOGRAM + QUANTILES)
def duration_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.quantiles(day_events(spark, sf_dir), ["run", "event_type"])


@query(HISTOGRAM + QUANTILES)
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from states of seven parts of the events, each reduced by itself and then added up."""
    e, keys = day_events(spark, sf_dir), ["run", "event_type"]
    states = aggregate.cells(e.withColumn("part", F.col("arrival") % 7), [*keys, "part"]).drop("part")
    return aggregate.from_cells(aggregate.merged(states, keys), keys).drop("count", "errors")


@query(HISTOGRAM + "SELECT run, event_type, CAST(bucket AS INT) AS bucket, count(*) AS n FROM b GROUP BY ALL")
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.histogram(day_events(spark, sf_dir), ["run", "event_type"])


@query(
    DAYS
    + """, m AS (SELECT run, event_type, 'k' AS name, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS v FROM e
UNION ALL SELECT run, event_type, 'us', CAST(us AS DOUBLE) FROM e)
SELECT run, event_type, name, count(*) AS count, sum(v) AS sum, min(v) AS min, max(v) AS max FROM m GROUP BY ALL"""
)
def measures_by_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", '"k": *([0-9.]+)', 1).try_cast("double")
    e = day_events(spark, sf_dir).withColumn("measures", F.create_map(F.lit("k"), k, F.lit("us"), F.col("duration_us").cast("double")))
    return aggregate.measure_stats(e, ["run", "event_type"])


@query(
    DAYS
    + """, c AS (SELECT run AS run_id, event_type AS behavior_id, user_id AS scope_id, count(*) AS n, min(event_id) AS first FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first, behavior_id, scope_id) AS place FROM c)
SELECT run_id, behavior_id, CASE WHEN place <= 100 THEN scope_id END AS scope_id, CAST(sum(n) AS BIGINT) AS count FROM k GROUP BY ALL"""
)
def scope_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the cap at 100 cells a run, so that the rest is seen to fold."""
    e = day_events(spark, sf_dir).withColumnsRenamed({"run": "run_id", "event_type": "behavior_id", "user_id": "scope_id"})
    return aggregate.scope_cells(e, 100)


@query(
    DAYS
    + """, f AS (SELECT run, user_id, min(event_id) AS first FROM e GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first, user_id) AS place FROM f)
SELECT e.run AS run_id, CASE WHEN p.place <= 40 THEN CAST(e.user_id AS VARCHAR) ELSE '<behaviors past the cap>' END AS behavior_id, count(*) AS count,
       count(*) FILTER (WHERE failed) AS errors, CAST(count(CASE WHEN p.place <= 40 THEN us END) AS BIGINT) AS timed FROM e JOIN p USING (run, user_id) GROUP BY ALL"""
)
def behavior_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviors past the first 40 of a run fold into one, without their durations."""
    e = day_events(spark, sf_dir).select(F.col("run").alias("run_id"), F.col("user_id").cast("string").alias("behavior_id"), F.lit("log").alias("kind"), "arrival", "duration_us", "outcome")
    return aggregate.capped(e, 40).groupBy("run_id", "behavior_id").agg(F.count("*").alias("count"), F.count_if(F.col("outcome") == "failure").alias("errors"), F.count("duration_us").alias("timed"))


@query(DAYS + "SELECT run AS run_id, user_id AS behavior_id, event_type AS first_stream, event_id AS first_seq FROM (SELECT *, row_number() OVER (PARTITION BY run, user_id ORDER BY event_id) AS p FROM e) WHERE p = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = day_events(spark, sf_dir)
    return aggregate.first_occurrence(e.select(F.col("run").alias("run_id"), F.col("user_id").alias("behavior_id"), "arrival", F.col("event_type").alias("stream"), F.col("arrival").alias("seq")))


def counts(spark: SparkSession, sf_dir: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    e = day_events(spark, sf_dir)
    return e.groupBy("context", "run", *keys).agg(F.count("*").alias("count")), day_runs(e)


@query(
    compared_sql("count(*)")
    + """SELECT run, event_type, user_id, CASE WHEN cur IS NOT NULL THEN 'new' ELSE 'disappeared' END AS kind, coalesce(cur, 0.0) AS current, CAST(n AS INT) AS n,
       CAST(present_in AS INT) AS present_in, med AS median, round((n + 1.0::DOUBLE) / (n + 2.0::DOUBLE), 2) AS confidence
FROM w WHERE n >= 2 AND ((cur IS NOT NULL AND present_in = 0) OR (cur IS NULL AND present_in = n))"""
)
def presence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, runs = counts(spark, sf_dir, BEHAVIOR)
    return compare.presence(compare.wide(a, runs, BEHAVIOR), BEHAVIOR).drop("context")


FREQUENCY = """SELECT run, {keys}, 'frequency' AS kind, cur AS current, CAST(n AS INT) AS n, lo = hi AS exact, med AS median, lo AS min, hi AS max,
       round((n + 1.0::DOUBLE) / (n + 2.0::DOUBLE) * CASE WHEN lo = hi THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (hi - lo) / abs(cur - med) END, 2) AS confidence
FROM w WHERE n >= 2 AND present_in = n AND cur IS NOT NULL AND (cur < lo OR cur > hi) AND (lo = hi OR abs(cur - med) > 2 * (hi - lo))"""


@query(compared_sql("count(*)", "user_id") + FREQUENCY.format(keys="user_id"))
def frequency_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, runs = counts(spark, sf_dir, ["user_id"])
    return compare.frequency(compare.wide(a, runs, ["user_id"]), ["user_id"]).drop("context")


@query(
    DAYS
    + """, a AS (SELECT r.ord, user_id, count(*) FILTER (WHERE failed) AS errors FROM e JOIN r USING (run) GROUP BY ALL),
w AS (SELECT c.run, c.ord, user_id, max(CASE WHEN a.ord = c.ord THEN errors END) AS cur, count(*) FILTER (WHERE a.ord < c.ord) AS ran,
             count(*) FILTER (WHERE a.ord < c.ord AND errors > 0) AS failures FROM r c JOIN a ON a.ord BETWEEN c.ord - 10 AND c.ord GROUP BY ALL)
SELECT run, user_id, 'error' AS kind, CAST(cur AS DOUBLE) AS current, CAST(ran AS INT) AS n, CAST(failures AS INT) AS failures,
       round(1.0::DOUBLE - (failures + 1.0::DOUBLE) / (ran + 2.0::DOUBLE), 2) AS confidence FROM w WHERE cur > 0 AND ran > 0 AND failures = 0"""
)
def error_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = day_events(spark, sf_dir)
    stats = e.groupBy("context", "run", "user_id").agg(F.count_if(F.col("outcome") == "failure").alias("errors"), F.array().cast("array<string>").alias("reasons"))
    return compare.errors(stats, day_runs(e), ["user_id"]).drop("context")


LATENCY = "CAST(sum(us) AS DOUBLE) / 1000.0::DOUBLE / count(*)"
SLOW = "cur IS NOT NULL AND present_in >= 2 AND cur - med > greatest(100.0, 3.0 * med) AND cur > hi AND cur - med > 2.0 * (hi - lo)"
SURE = "round((present_in + 1.0::DOUBLE) / (present_in + 2.0::DOUBLE) * ((cur - med) / greatest(100.0::DOUBLE, 3.0 * med)) / (1.0 + (cur - med) / greatest(100.0::DOUBLE, 3.0 * med)), 2)"


def means(e: DataFrame, keys: list[str]) -> DataFrame:
    return e.groupBy("context", "run", *keys).agg((F.sum("duration_us").cast("double") / 1000.0 / F.count("*")).alias("ms"))


@query(compared_sql(LATENCY) + f"SELECT run, event_type, user_id, 'latency' AS kind, cur AS current, CAST(present_in AS INT) AS n, med AS median, {SURE} AS confidence FROM w WHERE {SLOW}")
def latency_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = day_events(spark, sf_dir)
    return compare.latency(compare.wide(means(e, BEHAVIOR), day_runs(e), BEHAVIOR, "ms"), BEHAVIOR).drop("context")


@query(
    compared_sql(LATENCY)
    + f""", t AS (SELECT r.ord, event_type, CAST(sum(us) AS DOUBLE) / 1000.0::DOUBLE AS ms FROM e JOIN r USING (run) GROUP BY ALL),
k AS (SELECT c.ord, t.event_type, max(CASE WHEN t.ord = c.ord THEN ms END) AS total_now, median(CASE WHEN t.ord < c.ord THEN ms END) AS total_med,
             mad(CASE WHEN t.ord < c.ord THEN ms END) AS total_mad FROM r c JOIN t ON t.ord BETWEEN c.ord - 10 AND c.ord GROUP BY ALL)
SELECT w.run, event_type, user_id, 'latency' AS kind, cur AS current, CAST(present_in AS INT) AS n, med AS median, {SURE} AS confidence
FROM w JOIN k USING (ord, event_type) WHERE {SLOW}
  AND NOT ((total_now - total_med) - (cur - med) > (cur - med) AND (total_now - total_med) - (cur - med) > 3.0 * 1.4826 * total_mad)"""
)
def latency_stall_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As before, less what a slower day of the whole event type explains."""
    e = day_events(spark, sf_dir)
    runs = day_runs(e)
    totals = e.groupBy("context", "run", "event_type").agg((F.sum("duration_us").cast("double") / 1000.0).alias("ms"))
    window = compare.wide(totals, runs, ["event_type"], "ms").select("run", "event_type", F.col("vals").alias("window"), F.col("current").alias("window_now"))
    rows = compare.wide(means(e, BEHAVIOR), runs, BEHAVIOR, "ms").join(window, ["run", "event_type"]).withColumn("excess", F.col("current") - median_of(F.col("vals")))
    return compare.latency(rows, BEHAVIOR, window=("window", "window_now", "excess")).drop("context")


@query(
    compared_sql(LATENCY, "user_id")
    + f""", s AS (SELECT *, CASE WHEN cur IS NOT NULL AND present_in > 0 THEN cur - med END AS slow FROM w),
b AS (SELECT *, greatest(lag(slow) OVER o, lead(slow) OVER o) AS neighbour FROM s WINDOW o AS (PARTITION BY run ORDER BY user_id))
SELECT run, user_id, 'latency' AS kind, cur AS current, CAST(present_in AS INT) AS n, med AS median, {SURE} AS confidence
FROM b WHERE {SLOW} AND coalesce(neighbour, 0.0) < 0.5 * slow
  AND (SELECT count(*) FROM s WHERE s.run = b.run AND s.slow >= 0.5 * b.slow) - 1 < 3"""
)
def latency_cohort_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in order of their number stand for examples in the order they ran."""
    e = day_events(spark, sf_dir)
    rows = compare.slowdowns(compare.wide(means(e, ["user_id"]), day_runs(e), ["user_id"], "ms"), "user_id")
    return compare.latency(rows, ["user_id"], neighbour="neighbour", slowdowns="slowdowns").drop("context")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, gone and changed counts of (event type, user), grouped by event type."""
    a, runs = counts(spark, sf_dir, BEHAVIOR)
    compared = compare.wide(a, runs, BEHAVIOR)
    # no count is new or gone and changed too, so one pass finds both
    moved = F.when(F.col("now") & (F.col("present_in") == F.col("n")), rules.frequency(F.col("vals"), F.col("current")))
    found = compared.withColumns({"seen": rules.presence(F.col("now"), F.col("present_in"), F.col("n")), "moved": moved}).where("seen is not null or moved is not null")
    both = found.select("context", "run", *BEHAVIOR, F.coalesce("seen.kind", F.lit("frequency")).alias("kind"), F.coalesce("current", F.lit(0.0)).alias("current"), F.coalesce("seen.confidence", "moved.confidence").alias("confidence"))
    named = both.withColumn("behavior", F.concat_ws(":", "event_type", F.lpad(F.col("user_id").cast("string"), 8, "0"))).withColumn("measure", F.lit("count"))
    outside = F.col("event_type") == "error"
    tiered = named.withColumn("tier", compare.tier(F.col("kind"), outside=outside)).withColumn("group_key", F.col("event_type")).withColumn("moved", F.col("kind") == "frequency")
    return materialise(tiered, "signals")  # few, and read more than once by what ranks and counts them


RANKED = (
    compared_sql("count(*)")
    + """, s AS (
SELECT run, event_type, user_id, 'frequency' AS kind, cur AS current, round((n + 1.0::DOUBLE) / (n + 2.0::DOUBLE) * CASE WHEN lo = hi THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (hi - lo) / abs(cur - med) END, 2) AS confidence, 3 AS tier, 4 AS k
FROM w WHERE n >= 2 AND present_in = n AND cur IS NOT NULL AND (cur < lo OR cur > hi) AND (lo = hi OR abs(cur - med) > 2 * (hi - lo))
UNION ALL
SELECT run, event_type, user_id, CASE WHEN cur IS NOT NULL THEN 'new' ELSE 'disappeared' END, coalesce(cur, 0.0), round((n + 1.0::DOUBLE) / (n + 2.0::DOUBLE), 2),
       CASE WHEN cur IS NOT NULL AND event_type = 'error' THEN 1 ELSE 4 END, CASE WHEN cur IS NOT NULL THEN 2 ELSE 3 END
FROM w WHERE n >= 2 AND ((cur IS NOT NULL AND present_in = 0) OR (cur IS NULL AND present_in = n))),
p AS (SELECT *, event_type || ':' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS behavior FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY run, event_type ORDER BY kind = 'frequency' DESC, tier, confidence DESC, k, behavior) AS place FROM p),
h AS (SELECT run, event_type, row_number() OVER (PARTITION BY run ORDER BY tier, confidence DESC, k, behavior) AS group_rank FROM i WHERE place = 1)
"""
)


@query(RANKED + "SELECT run, behavior, kind, current, confidence, CAST(tier AS INT) AS tier, CAST(group_rank AS INT) AS group_rank, CAST(place AS INT) AS place, place = 1 AS head FROM i JOIN h USING (run, event_type)")
def ranked_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.ranked(signals(spark, sf_dir)).select("run", "behavior", "kind", "current", "confidence", "tier", "group_rank", "place", "head")


@query(RANKED + "SELECT run, event_type AS group_key, CAST(group_rank AS INT) AS group_rank, count(*) AS members, max(CASE WHEN place = 1 THEN behavior END) AS head FROM i JOIN h USING (run, event_type) GROUP BY ALL")
def signal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.ranked(signals(spark, sf_dir))
    return rows.groupBy("run", "group_key", "group_rank").agg(F.count("*").alias("members"), F.max(F.when(F.col("head"), F.col("behavior"))).alias("head"))


@query(RANKED + "SELECT run, count(*) AS found, count(*) > 20 AS refused FROM i GROUP BY run")
def flood_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with over 20 signals keep none; with the share that stays."""
    s = signals(spark, sf_dir)
    kept = compare.refused(s, 20).groupBy("run").agg(F.count("*").alias("kept"))
    return s.groupBy("run").agg(F.count("*").alias("found")).join(kept, "run", "left").select("run", "found", F.col("kept").isNull().alias("refused"))


@query(
    compared_sql("count(*)", "user_id")
    + """, x AS (SELECT r.run, r.ord, count(DISTINCT event_type) AS dummy, count(*) AS size FROM e JOIN r USING (run) GROUP BY ALL),
z AS (SELECT c.run, c.size AS now, min(b.size) AS lo, max(b.size) AS hi FROM x c LEFT JOIN x b ON b.ord BETWEEN c.ord - 10 AND c.ord - 1 GROUP BY c.run, c.size),
pa AS (SELECT r.ord, user_id, count(*)::DOUBLE / max(x.size) AS v, count(DISTINCT event_type) AS in_examples FROM e JOIN r USING (run) JOIN x USING (run) GROUP BY ALL),
pw AS (SELECT c.run, c.ord, user_id, least(c.ord - 1, 10) AS n, max(CASE WHEN pa.ord = c.ord THEN v END) AS cur, max(CASE WHEN pa.ord = c.ord THEN in_examples END) AS in_examples,
              count(CASE WHEN pa.ord < c.ord THEN v END) AS present_in, min(CASE WHEN pa.ord < c.ord THEN v END) AS lo, max(CASE WHEN pa.ord < c.ord THEN v END) AS hi, median(CASE WHEN pa.ord < c.ord THEN v END) AS med
       FROM r c JOIN pa ON pa.ord BETWEEN c.ord - 10 AND c.ord GROUP BY ALL),
pm AS (SELECT run, user_id, in_examples, (n >= 2 AND present_in = n AND cur IS NOT NULL AND (cur < lo OR cur > hi) AND (lo = hi OR abs(cur - med) > 2 * (hi - lo))) AS moved FROM pw)
SELECT w.run, w.user_id, w.cur AS current, coalesce(z.now < z.lo OR z.now > z.hi, FALSE) AND pm.in_examples >= 2 AND NOT pm.moved AS suite_size
FROM w JOIN z USING (run) JOIN pm USING (run, user_id)
WHERE n >= 2 AND present_in = n AND cur IS NOT NULL AND (cur < w.lo OR cur > w.hi) AND (w.lo = w.hi OR abs(cur - med) > 2 * (w.hi - w.lo))"""
)
def suite_size_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = day_events(spark, sf_dir)
    runs = day_runs(e)
    a = e.groupBy("context", "run", "user_id").agg(F.count("*").alias("count"), F.count_distinct("event_type").alias("in_examples"))
    size = e.groupBy("context", "run").agg(F.count("*").alias("examples"))
    found = compare.frequency(compare.wide(a, runs, ["user_id"]), ["user_id"])
    return compare.demoted(found, a, size, runs, ["user_id"]).select("run", "user_id", "current", "suite_size")


OUTCOME = (
    compared_sql("count(*)", "user_id")
    + """, s AS (SELECT run, ord, user_id, lo, hi, med, n FROM w WHERE n >= 2 AND present_in = n AND cur IS NOT NULL AND (cur < lo OR cur > hi) AND (lo = hi OR abs(cur - med) > 2 * (hi - lo))),
j AS (SELECT s.run, s.user_id, r.ord, coalesce((a.v < s.lo OR a.v > s.hi) AND (s.lo = s.hi OR abs(a.v - s.med) > 2 * (s.hi - s.lo)), FALSE) AS firing
      FROM s JOIN r ON r.ord > s.ord LEFT JOIN a ON a.ord = r.ord AND a.user_id = s.user_id),
q AS (SELECT *, lag(firing) OVER (PARTITION BY run, user_id ORDER BY ord) AS before, min(CASE WHEN NOT firing THEN ord END) OVER (PARTITION BY run, user_id) AS quiet,
             max(ord) OVER (PARTITION BY run, user_id) AS final FROM j),
o AS (SELECT run, user_id, CAST(min(quiet) AS INT) AS resolved_in, CAST(min(CASE WHEN firing AND ord > quiet THEN ord END) AS INT) AS recurred_in,
             count(*) FILTER (WHERE firing AND NOT coalesce(before, TRUE)) AS recurrences, bool_or(firing AND ord = final) AS firing FROM q GROUP BY ALL),
g AS (SELECT run, user_id, resolved_in, recurred_in, recurrences, CASE WHEN firing AND resolved_in IS NOT NULL THEN 'recurred' WHEN resolved_in IS NOT NULL THEN 'resolved' ELSE 'open' END AS status FROM o)
"""
)


def judged_frequencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The changed counts of users, and the votes of later days, each against the signal's own baseline."""
    a, runs = counts(spark, sf_dir, ["user_id"])
    found = compare.frequency(compare.wide(a, runs, ["user_id"]), ["user_id"])
    return found, outcomes.frequency_votes(found, a, runs, ["user_id"])


@query(OUTCOME + "SELECT run, user_id, status, resolved_in, recurred_in, recurrences FROM g")
def signal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, votes = judged_frequencies(spark, sf_dir)
    return outcomes.outcomes(votes, ["run", "user_id"]).select("run", "user_id", "status", "resolved_in", "recurred_in", "recurrences")


@query(
    OUTCOME
    + """, d AS (SELECT DISTINCT run, user_id % 11 AS grp FROM s WHERE user_id % 7 = 0),
h AS (SELECT s.run, s.user_id, g.status, row_number() OVER (PARTITION BY s.user_id ORDER BY s.run) AS place FROM s JOIN g ON g.run = s.run AND g.user_id = s.user_id LEFT JOIN d ON d.run = s.run AND d.grp = s.user_id % 11
      WHERE g.status IN ('open', 'recurred') AND d.run IS NULL AND s.user_id NOT IN (SELECT user_id FROM s WHERE ord = (SELECT max(ord) FROM r)))
SELECT run, user_id, status FROM h WHERE place = 1"""
)
def open_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders: the oldest signal of each user that still holds, unless its group was judged or the last day raises it again."""
    found, votes = judged_frequencies(spark, sf_dir)
    outcome = outcomes.outcomes(votes, ["run", "user_id"])
    signals = found.withColumn("group_key", (F.col("user_id") % 11).cast("string"))
    last = day_runs(day_events(spark, sf_dir)).agg(F.max("run").alias("run"))
    now = signals.join(F.broadcast(last), "run", "left_semi").select("user_id")
    judged = signals.where("user_id % 7 = 0").select("run", "group_key").distinct()
    held = outcomes.still_open(signals, outcome, now, judged, ["user_id"])
    return held.join(outcome.select("run", "user_id", "status"), ["run", "user_id"]).select("run", "user_id", "status")


@query(
    OUTCOME
    + """, k AS (SELECT s.run, s.user_id, CASE WHEN lo = hi THEN 'exact' ELSE 'varying' END AS kind, coalesce(g.status, 'open') AS status, s.user_id % 3 = 0 AS examined, s.user_id % 7 = 0 AS dismissed
      FROM s LEFT JOIN g ON g.run = s.run AND g.user_id = s.user_id),
t AS (SELECT kind, count(*) AS raised, count(*) FILTER (WHERE status <> 'unknown') AS judged, count(*) FILTER (WHERE status = 'unknown') AS unjudged, count(*) FILTER (WHERE examined) AS examined, count(*) FILTER (WHERE dismissed) AS dismissed,
             count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'resolved' AND NOT examined) AS resolved_unexamined, count(*) FILTER (WHERE status = 'recurred') AS recurred, count(*) FILTER (WHERE status = 'open') AS open
      FROM k GROUP BY ROLLUP (kind)),
d AS (SELECT *, examined::DOUBLE / nullif(judged, 0) AS x, CASE WHEN judged < 10 THEN 1 WHEN judged < 100 THEN 2 ELSE 3 END AS xd,
             resolved_unexamined::DOUBLE / nullif(resolved, 0) AS y, CASE WHEN resolved < 10 THEN 1 WHEN resolved < 100 THEN 2 ELSE 3 END AS yd FROM t)
SELECT kind, raised, judged, unjudged, examined, dismissed, resolved, resolved_unexamined, recurred, open,
       CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round(x, CAST(xd - 1 - floor(log10(x)) AS INT)) END AS examined_rate, CASE WHEN y = 0 THEN 0.0::DOUBLE ELSE round(y, CAST(yd - 1 - floor(log10(y)) AS INT)) END AS unexamined_rate FROM d"""
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how the baseline stood; a third of users counts as examined, a seventh as dismissed."""
    found, votes = judged_frequencies(spark, sf_dir)
    known = outcomes.outcomes(votes, ["run", "user_id"]).select("run", "user_id", "status")
    rows = found.join(known, ["run", "user_id"], "left").select(F.when(F.col("exact"), "exact").otherwise("varying").alias("kind"), F.coalesce("status", F.lit("open")).alias("status"), (F.col("user_id") % 3 == 0).alias("examined"), (F.col("user_id") % 7 == 0).alias("dismissed"))
    return outcomes.scorecard(rows)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = day_events(spark, sf_dir)
    return e.groupBy(F.lit("all").alias("run_id"), F.col("user_id").alias("behavior_id")).agg(F.count("*").alias("count"), F.count_if(F.col("outcome") == "failure").alias("errors"), F.sum("duration_us").alias("duration_total_us"))


TOTALS = DAYS + ", s AS (SELECT 'all' AS run_id, user_id AS behavior_id, count(*) AS count, count(*) FILTER (WHERE failed) AS errors, CAST(sum(us) AS BIGINT) AS duration_total_us FROM e GROUP BY user_id)\n"


@query(TOTALS + "SELECT behavior_id, count, errors FROM s ORDER BY count DESC, behavior_id LIMIT 20")
def summary_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.summary(totals(spark, sf_dir)).select("behavior_id", "count", "errors")


@query(TOTALS + "SELECT behavior_id, duration_total_us, count FROM s ORDER BY duration_total_us DESC, count DESC, behavior_id LIMIT 20")
def summary_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.summary(totals(spark, sf_dir), "time").select("behavior_id", "duration_total_us", "count")


@query(
    TOTALS
    + """, t AS (SELECT behavior_id, count, row_number() OVER (ORDER BY count DESC, behavior_id) AS p FROM s)
SELECT run_id, count(*) AS behaviors, CAST(sum(count) AS BIGINT) AS events, CAST(sum(errors) AS BIGINT) AS error_events, count(*) FILTER (WHERE errors > 0) AS error_behaviors,
       arg_max(behavior_id, (errors, behavior_id)) FILTER (WHERE errors > 0) AS worst, arg_max(behavior_id, (duration_total_us, behavior_id)) AS slowest,
       count(*) FILTER (WHERE count = 1) AS seen_once, round(count(*) FILTER (WHERE count = 1)::DOUBLE / count(*), 2) AS seen_once_share,
       (SELECT behavior_id FROM t WHERE p = 1) AS top_1, (SELECT behavior_id FROM t WHERE p = 2) AS top_2, (SELECT behavior_id FROM t WHERE p = 3) AS top_3,
       (SELECT round(t.count::DOUBLE / (SELECT sum(count) FROM s), 2) FROM t WHERE p = 1) AS top_share FROM s GROUP BY run_id"""
)
def describe_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregate.describe(totals(spark, sf_dir))
    tops = [F.element_at("top", i)["behavior_id"].alias(f"top_{i}") for i in (1, 2, 3)]
    return d.select(*[c for c in d.columns if c != "top"], *tops, share(F.element_at("top", 1)["count"], F.col("events")).alias("top_share"))


def slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.explode(F.array(F.struct(F.col("event_type").alias("slot"), F.col("props").alias("v")), F.struct(F.lit("user").alias("slot"), F.col("user_id").cast("string").alias("v")), F.struct(F.lit("type").alias("slot"), F.col("event_type").alias("v")))).alias("x"))
    return rows.select("x.slot", F.col("x.v").alias("value"), F.lit("quoted").alias("kind"))


@query(
    """WITH t AS (SELECT event_type AS slot, props AS v FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'type', event_type FROM events),
c AS (SELECT slot, v, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT slot, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_values, count(*) FILTER (WHERE n >= 3) AS established, coalesce(sum(n) FILTER (WHERE n >= 3), 0) AS covered FROM c GROUP BY slot)
SELECT slot, total, distinct_values, CASE WHEN distinct_values > 5000 OR (total >= 5 AND (distinct_values::DOUBLE / total >= 0.8 OR (distinct_values::DOUBLE / total >= 0.5 AND distinct_values >= 20))) THEN 'identifier'
  WHEN distinct_values = 1 THEN 'constant' WHEN total >= 20 AND established BETWEEN 2 AND 10 AND covered::DOUBLE / total >= 0.9 THEN 'enum' ELSE 'unknown' END AS class,
  round(total::DOUBLE / (total + 15.0::DOUBLE), 2) AS confidence FROM s"""
)
def slot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.slots import classify

    return classify(slot_values(spark, sf_dir), ["slot"]).select("slot", "total", "distinct_values", "class", "confidence")


@query(
    """WITH t AS (SELECT event_type AS slot, props AS v FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'type', event_type FROM events),
c AS (SELECT slot, v, count(*) AS n, row_number() OVER (PARTITION BY slot ORDER BY count(*) DESC, v NULLS FIRST) AS p FROM t GROUP BY slot, v)
SELECT slot, string_agg(v, '|' ORDER BY p) FILTER (WHERE p <= 5) AS samples, count(*) AS distinct_values FROM c GROUP BY slot"""
)
def slot_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest values of each position."""
    from ..operators.slots import statistics

    return statistics(slot_values(spark, sf_dir), ["slot"]).select("slot", F.array_join("samples", "|").alias("samples"), "distinct_values")


NUMBER = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query(
    DAYS
    + f""", u AS (SELECT run, event_type, CAST(sum(us) AS BIGINT) AS us, CAST(sum(length(props)) * 1000 AS BIGINT) AS size, count(*) AS n FROM e GROUP BY ALL),
d AS (SELECT *, CASE WHEN us < 1000000 THEN us / 1000.0::DOUBLE ELSE us / 1000000.0::DOUBLE END AS t, CASE WHEN size < 1048576 THEN size / 1024.0::DOUBLE ELSE size / 1048576.0::DOUBLE END AS b FROM u),
s AS (SELECT *, CASE WHEN t < 10 THEN round(t * 100) / 100 WHEN t < 100 THEN round(t * 10) / 10 WHEN t < 1000 THEN round(t) ELSE round(t / 10) * 10 END AS rt,
             CASE WHEN b < 10 THEN round(b * 100) / 100 WHEN b < 100 THEN round(b * 10) / 10 WHEN b < 1000 THEN round(b) ELSE round(b / 10) * 10 END AS rb FROM d)
SELECT run, event_type, CASE WHEN us < 1000 THEN us || 'µs' WHEN us < 1000000 THEN {NUMBER.format("rt")} || 'ms' ELSE {NUMBER.format("rt")} || 's' END AS took,
       CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {NUMBER.format("rb")} || ' KB' ELSE {NUMBER.format("rb")} || ' MB' END AS size, n || CASE WHEN n = 1 THEN ' event' ELSE ' events' END AS events FROM s"""
)
def usage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of events took in a day, as people read it: time, a size of a thousand times its properties, a count."""
    from ..functions import display

    sums = day_events(spark, sf_dir).groupBy("run", "event_type").agg(F.sum("duration_us").alias("us"), (F.sum(F.length("props")) * 1000).alias("size"), F.count("*").alias("n"))
    return sums.select("run", "event_type", display.duration_text(F.col("us")).alias("took"), display.bytes_text(F.col("size")).alias("size"), display.plural(F.col("n"), "event").alias("events"))


@query(
    DAYS
    + """, c AS (SELECT run, user_id AS behavior, CASE event_type WHEN 'signup' THEN 'example' WHEN 'click' THEN 'request' WHEN 'view' THEN CASE WHEN user_id % 3 > 0 THEN 'sql' END WHEN 'error' THEN 'stderr' END AS class FROM e)
SELECT run, class, count(*) AS n, count(DISTINCT behavior) AS behaviors FROM c GROUP BY ALL"""
)
def behavior_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of a day are of which class; those of none raise no signal."""
    from ..operators.detect import behavior_class

    e = day_events(spark, sf_dir)
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "test.example"), ("click", "http.request"), ("view", "db.query"), ("error", "log"), ("purchase", "log")) for x in p]), F.col("event_type"))
    template = F.when(F.col("user_id") % 3 > 0, "User Load SELECT").otherwise("TRANSACTION BEGIN")
    stream = F.when(F.col("event_type") == "error", "stderr").otherwise("stdout")
    found = e.withColumn("class", behavior_class(kind, template, stream, F.lit(True), F.lit(False)))
    return found.groupBy("run", "class").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("behaviors"))


@query("SELECT conv_id AS behavior_id, CAST(p - 1 AS INT) AS position, turn AS seq, substr(text, 1, 1024) AS line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations) WHERE p <= 3")
def exemplars_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns of each conversation: of the kept lines, those that don't depend on a hash."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = c.select(F.lit("all").alias("run_id"), F.col("conv_id").alias("behavior_id"), F.struct("turn", "role", "text").alias("arrival"), F.lit("stdout").alias("stream"), F.col("turn").alias("seq"), F.col("text").alias("line"))
    return aggregate.exemplars(lines, first=3).where("position < 3").select("behavior_id", "position", "seq", "line")


RUNS = """
WITH o AS (SELECT o_custkey AS context, o_orderkey AS run, o_orderdate AS started, o_orderstatus <> 'P' AS usable, o_orderpriority LIKE '1%' AS live, o_totalprice > 1000 AS has_stats, o_orderstatus = 'O' AS has_evidence FROM orders)
"""


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("context"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"), (F.col("o_orderstatus") != "P").alias("usable"), F.col("o_orderpriority").startswith("1").alias("live"), (F.col("o_totalprice") > 1000).alias("has_stats"), (F.col("o_orderstatus") == "O").alias("has_evidence"))


@query(
    RUNS
    + """, p AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS usable_place, max(started) OVER (PARTITION BY context) < TIMESTAMP '1995-01-01' AS idle
FROM o WINDOW w AS (PARTITION BY context ORDER BY started DESC, run DESC)),
a AS (SELECT context, run, started, CASE WHEN live THEN NULL WHEN has_stats AND (idle OR (place > 6 AND NOT (usable AND usable_place <= 21))) THEN 'stats' WHEN has_evidence AND place > 3 THEN 'evidence' END AS action FROM p)
SELECT * FROM a WHERE action IS NOT NULL"""
)
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contexts, orders as runs."""
    return outcomes.retention_plan(order_runs(spark, sf_dir), stats_runs=6, evidence_runs=3, idle_before="1995-01-01")


@query(
    RUNS
    + """SELECT context, count(*) AS runs, count(*) FILTER (WHERE has_stats) AS with_stats, count(*) FILTER (WHERE has_evidence) AS with_evidence, min(run) AS first_run, max(run) AS last_run,
       min(started) AS first_started, max(started) AS last_started FROM o GROUP BY context"""
)
def context_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.context_rollup(order_runs(spark, sf_dir))


@query(
    DAYS
    + """SELECT r.run, CAST(r.ord AS INT) AS ord, CAST(b.ord AS INT) AS base_ord FROM r JOIN r b ON b.ord BETWEEN r.ord - 10 AND r.ord - 1"""
)
def run_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = day_runs(day_events(spark, sf_dir))
    return compare.baselines(runs).join(runs.select("run", "ord"), "ord").select("run", "ord", "base_ord")


@query(
    """WITH d AS (SELECT event_type, user_id, ts, value, CAST(epoch_us(ts) AS BIGINT) AS us FROM events WHERE event_type <> 'error'),
s AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us, event_id FROM events WHERE event_type = 'error')
SELECT s.event_id, (SELECT max(d.us) FROM d WHERE d.user_id = s.user_id AND d.us <= s.us) AS before_us FROM s"""
)
def as_of_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, when its user was last seen before it."""
    from ..operators.ranges import as_of

    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left, right = e.where("event_type = 'error'").select("event_id", "user_id", "us"), e.where("event_type <> 'error'").select("user_id", "us", F.col("us").alias("before_us"))
    return as_of(left, right, ["user_id"], "us", ["before_us"]).select("event_id", "before_us")


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT conv_id, turn, role, lag(role) OVER w AS before_role, lead(role) OVER w AS after_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranges import beside

    return beside(rows_of(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], {"role": "role"}).select("conv_id", "turn", "role", "before_role", "after_role")


@query(
    DAYS
    + """, a AS (SELECT r.ord, event_type, user_id, CAST(count(*) AS DOUBLE) AS v FROM e JOIN r USING (run) GROUP BY ALL),
k AS (SELECT DISTINCT c.ord, event_type, user_id FROM r c JOIN a ON a.ord BETWEEN c.ord - 10 AND c.ord WHERE c.ord > 1),
v AS (SELECT k.*, coalesce(a.v, 0.0) AS v FROM k JOIN r b ON b.ord BETWEEN k.ord - 10 AND k.ord - 1 LEFT JOIN a ON a.ord = b.ord AND a.event_type = k.event_type AND a.user_id IS NOT DISTINCT FROM k.user_id),
m AS (SELECT ord, event_type, user_id, median(v) AS middle FROM v GROUP BY ALL),
o AS (SELECT m.*, coalesce(a.v, 0.0) AS own FROM m LEFT JOIN a ON a.ord = m.ord AND a.event_type = m.event_type AND a.user_id IS NOT DISTINCT FROM m.user_id WHERE coalesce(a.v, 0.0) <> middle)
SELECT run, user_id, max(event_type) AS owner, max(own) AS owner_current, max(middle) AS owner_median FROM o JOIN r USING (ord) GROUP BY run, user_id HAVING count(*) = 1"""
)
def signal_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as the scopes of a user, over all rows."""
    from ..operators.detect import owners

    e = day_events(spark, sf_dir)
    scopes = e.groupBy("context", "run", "user_id", F.col("event_type").alias("scope_id")).agg(F.count("*").alias("count"))
    return owners(scopes, day_runs(e), ["user_id"]).drop("context")


@query(
    DAYS
    + """, a AS (SELECT r.ord, user_id, event_type FROM e JOIN r USING (run) GROUP BY ALL),
k AS (SELECT DISTINCT c.run, user_id, event_type FROM r c JOIN a ON a.ord BETWEEN c.ord - 10 AND c.ord)
SELECT run, user_id, max(event_type) AS sole FROM k GROUP BY ALL HAVING count(*) = 1"""
)
def sole_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.detect import sole_scope

    e = day_events(spark, sf_dir)
    return sole_scope(e.select("context", "run", "user_id", F.col("event_type").alias("scope_id")).distinct(), day_runs(e), ["user_id"]).drop("context")
