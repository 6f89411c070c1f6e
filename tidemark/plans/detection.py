"""Whole detection over the events table: each day is a run, and its event types are kinds of behaviors of a test suite.

signup: examples (a user's; a failure above 150), click: requests (with queries), view: queries made within the user's
example where that ran, error: lines on stderr, purchase: lines that a test run leaves unjudged, on every ninth day past
the cap on behaviors. The SQL is written from the rules, run by run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, detection, explain, outcomes
from ..registry import query
from .telemetry import DAYS

BAD = 150


def suite_stats(spark: SparkSession, sf_dir: str) -> detection.Stats:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), (F.dayofmonth("ts") % 9 == 0).alias("cut"), "event_id", "event_type", "user_id", "value",
        F.floor(F.col("value") * 1000).cast("long").alias("us"), F.regexp_extract("props", '"k": *([0-9.]+)', 1).try_cast("double").alias("k"),
    )
    user = F.col("user_id").cast("string")
    of = lambda n: (F.col("user_id") % n).cast("string")
    kind = {"signup": "test.example", "click": "http.request", "view": "db.query", "error": "log", "purchase": "log"}
    name = {"signup": F.concat(F.lit("ex-"), user), "click": F.concat(F.lit("rq-"), of(25)), "view": F.concat(F.lit("sq-"), of(20)), "error": F.concat(F.lit("er-"), of(30)), "purchase": F.when(F.col("cut"), aggregate.OVERFLOW)}
    text = {"signup": F.concat(F.lit("spec/"), of(7), F.lit("_spec.rb # "), user), "error": F.concat(F.rpad(F.concat(F.lit("warning "), ((F.col("user_id") % 30) % 6).cast("string")), 60, "."), of(30)), "purchase": F.lit(aggregate.OVERFLOW)}
    stream = {"signup": detection.RUNNER, "click": "file:log/test.log", "view": "file:log/test.log", "error": "stderr", "purchase": "stdout"}
    chosen = lambda values: F.coalesce(*[F.when(F.col("event_type") == t, v) for t, v in values.items()])
    rows = e.withColumns({"kind": chosen(kind), "behavior": chosen(name), "stream": chosen(stream)}).withColumn("template", F.coalesce(chosen(text), "behavior")).where("behavior is not null")
    timed = F.when(F.col("event_type").isin("signup", "click", "view"), F.col("us"))
    counts = rows.groupBy("run_id", "behavior", "kind", "template", "stream").agg(
        F.count("*").alias("count"), F.count_if((F.col("event_type") == "signup") & (F.col("value") > BAD)).alias("errors"), F.count(timed).alias("timed"), F.sum(timed).alias("total_us"),
        F.create_map(F.lit("queries"), F.sum("k")).alias("measures"), F.min("event_id").alias("seq"),
    )
    ran = e.where("event_type = 'signup'").select("run_id", "user_id").distinct()
    cells = rows.where("kind = 'db.query'").join(ran, ["run_id", "user_id"]).groupBy("run_id", "behavior", F.concat(F.lit("example:ex-"), user).alias("scope")).agg(F.count("*").alias("count")).withColumn("sums", F.lit(None).cast("map<string,double>"))
    runs = e.select("run_id").distinct().select("run_id", F.lit("events").alias("context"), F.col("run_id").alias("started"), F.lit(True).alias("usable"))
    return detection.assemble(runs, counts, cells)


MIDDLE = "list_aggregate({0}, 'median')"
FIRES = "({1} < list_min({0}) OR {1} > list_max({0})) AND (list_min({0}) = list_max({0}) OR abs({1} - list_aggregate({0}, 'median')) > 2 * (list_max({0}) - list_min({0})))"
SURE = "round((nb + 1.0::DOUBLE) / (nb + 2.0::DOUBLE) * CASE WHEN list_min({0}) = list_max({0}) THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (list_max({0}) - list_min({0})) / abs({1} - list_aggregate({0}, 'median')) END, 2)"
THREE = "CASE WHEN {0} = 0 THEN {0} WHEN floor(log10(abs({0}))) <= 2 THEN round({0} * pow(10.0, 2 - floor(log10(abs({0}))))) / pow(10.0, 2 - floor(log10(abs({0})))) ELSE round({0} / pow(10.0, floor(log10(abs({0}))) - 2)) * pow(10.0, floor(log10(abs({0}))) - 2) END"
NEED = "greatest(100.0::DOUBLE, 3.0 * list_aggregate(mss, 'median'))"
DETECTED = (
    DAYS
    + f""", v AS (SELECT run, event_id, event_type, user_id, value, us, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS k, CAST(substr(run, 9, 2) AS INT) % 9 = 0 AS cut FROM e),
ran AS (SELECT DISTINCT run, user_id FROM v WHERE event_type = 'signup'),
f0 AS (
  SELECT run, 'ex-' || user_id AS beh, 'test.example' AS kind, 'example' AS class, 'spec/' || (user_id % 7) || '_spec.rb # ' || user_id AS tmpl, count(*) AS n, count(*) FILTER (WHERE value > {BAD}) AS bad,
         sum(us) / 1000.0::DOUBLE AS total, NULL::DOUBLE AS q, min(event_id) AS seq FROM v WHERE event_type = 'signup' GROUP BY ALL
  UNION ALL SELECT run, 'rq-' || (user_id % 25), 'http.request', 'request', '', count(*), 0, sum(us) / 1000.0::DOUBLE, sum(k), min(event_id) FROM v WHERE event_type = 'click' GROUP BY ALL
  UNION ALL SELECT run, 'sq-' || (user_id % 20), 'db.query', 'sql', '', count(*), 0, sum(us) / 1000.0::DOUBLE, NULL, min(event_id) FROM v WHERE event_type = 'view' GROUP BY ALL
  UNION ALL SELECT run, 'er-' || (user_id % 30), 'log', 'stderr', rpad('warning ' || ((user_id % 30) % 6), 60, '.') || (user_id % 30), count(*), 0, NULL, NULL, min(event_id) FROM v WHERE event_type = 'error' GROUP BY ALL),
past AS (SELECT ord, count(*) FILTER (WHERE event_type = 'purchase' AND cut) AS past, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS size FROM v JOIN r USING (run) GROUP BY ord),
cl AS MATERIALIZED (SELECT ord, 'sq-' || (user_id % 20) AS beh, 'ex-' || user_id AS scope, count(*) AS n FROM v JOIN ran USING (run, user_id) JOIN r USING (run) WHERE event_type = 'view' GROUP BY ALL),
made AS (SELECT ord, scope AS beh, CAST(sum(n) AS DOUBLE) AS made FROM cl GROUP BY ALL),
inside AS (SELECT ord, beh, sum(n) AS scoped, count(*) AS scopes, max(scope) AS one FROM cl GROUP BY ALL),
f AS MATERIALIZED (SELECT r.ord, f0.*, total / f0.n AS ms, past, size, coalesce(scopes, 0) AS scopes, one, f0.n - coalesce(scoped, 0) AS loose,
             CASE WHEN kind = 'test.example' THEN CASE WHEN past = 0 THEN coalesce(made, 0.0) END ELSE q END AS queries
      FROM f0 JOIN r USING (run) JOIN past USING (ord) LEFT JOIN made USING (ord, beh) LEFT JOIN inside USING (ord, beh)),
w AS MATERIALIZED (SELECT c.ord, least(c.ord - 1, 10) AS nb, beh, kind, class, any_value(tmpl) AS tmpl, max(CASE WHEN f.ord = c.ord THEN f.n END) AS cur, max(CASE WHEN f.ord = c.ord THEN bad END) AS bad, max(CASE WHEN f.ord = c.ord THEN queries END) AS q,
             max(CASE WHEN f.ord = c.ord THEN ms END) AS ms, max(CASE WHEN f.ord = c.ord THEN total END) AS total, max(CASE WHEN f.ord = c.ord THEN scopes END) AS units, max(CASE WHEN f.ord = c.ord THEN loose END) AS loose,
             coalesce(list(CAST(f.n AS DOUBLE)) FILTER (WHERE f.ord < c.ord), []) AS ns, coalesce(list(queries) FILTER (WHERE f.ord < c.ord AND queries IS NOT NULL), []) AS qs, coalesce(list(ms) FILTER (WHERE f.ord < c.ord AND ms IS NOT NULL), []) AS mss,
             coalesce(list(total) FILTER (WHERE f.ord < c.ord AND total IS NOT NULL), []) AS totals, coalesce(list(CAST(loose AS DOUBLE)) FILTER (WHERE f.ord < c.ord), []) AS looses, coalesce(list(f.n::DOUBLE / size) FILTER (WHERE f.ord < c.ord AND size > 0), []) AS rates,
             count(*) FILTER (WHERE f.ord < c.ord AND bad > 0) AS failures, bool_and(scopes = 1 AND loose = 0) AND count(DISTINCT one) = 1 AS single, max(one) AS one
      FROM r c JOIN f ON f.ord BETWEEN c.ord - 10 AND c.ord WHERE c.ord > 1 GROUP BY c.ord, beh, kind, class),
b AS MATERIALIZED (SELECT c.ord, c.past, c.size, list(CAST(o.past AS DOUBLE)) AS pasts, bool_and(o.past > 0) AS all_past, bool_and(o.size > 0) AND bool_or(o.size <> c.size) AND c.size > 0 AS resized FROM past c JOIN past o ON o.ord BETWEEN c.ord - 10 AND c.ord - 1 GROUP BY c.ord, c.past, c.size),
kd AS (SELECT ord, kind, sum(total) AS t FROM f WHERE total IS NOT NULL GROUP BY ALL),
win AS (SELECT c.ord, kind, max(CASE WHEN kd.ord = c.ord THEN t END) AS now, median(CASE WHEN kd.ord < c.ord THEN t END) AS mid, mad(CASE WHEN kd.ord < c.ord THEN t END) AS spread FROM r c JOIN kd ON kd.ord BETWEEN c.ord - 10 AND c.ord GROUP BY ALL),
slow AS MATERIALIZED (SELECT w.ord, w.beh, w.ms - list_aggregate(w.mss, 'median') AS slow, f.seq FROM w JOIN f USING (ord, beh) WHERE w.class = 'example' AND cur IS NOT NULL),
near AS (SELECT *, greatest(lag(slow) OVER o, lead(slow) OVER o) AS neighbour FROM slow WINDOW o AS (PARTITION BY ord ORDER BY seq, beh)),
s0 AS MATERIALIZED (
  SELECT ord, beh, CASE WHEN cur IS NOT NULL THEN 'new' ELSE 'disappeared' END AS kind, 'count' AS measure, coalesce(cur, 0)::DOUBLE AS current, nb AS base, len(ns) AS present_in, {MIDDLE.format("ns")} AS median, round((nb + 1.0::DOUBLE) / (nb + 2.0::DOUBLE), 2) AS confidence
  FROM w JOIN b USING (ord) WHERE nb >= 2 AND ((cur IS NOT NULL AND len(ns) = 0 AND (kind = 'test.example' OR NOT all_past)) OR (cur IS NULL AND len(ns) = nb AND (kind = 'test.example' OR past = 0)))
  UNION ALL SELECT ord, beh, 'frequency', 'count', cur, nb, nb, {MIDDLE.format("ns")}, {SURE.format("ns", "cur")} FROM w WHERE nb >= 2 AND class <> 'example' AND cur IS NOT NULL AND len(ns) = nb AND {FIRES.format("ns", "cur")}
  UNION ALL SELECT ord, beh, 'frequency', 'queries', q, nb, nb, {MIDDLE.format("qs")}, {SURE.format("qs", "q")} FROM w WHERE nb >= 2 AND class IN ('example', 'request') AND cur IS NOT NULL AND q IS NOT NULL AND len(ns) = nb AND len(qs) = nb AND {FIRES.format("qs", "q")}
  UNION ALL SELECT ord, beh, 'error', 'failed', bad, len(ns), len(ns), NULL, round(1.0::DOUBLE - 1.0::DOUBLE / (len(ns) + 2.0::DOUBLE), 2) FROM w WHERE class = 'example' AND bad > 0 AND len(ns) > 0 AND failures = 0
  UNION ALL SELECT w.ord, w.beh, 'latency', 'duration_ms', {THREE.format("ms")}, len(mss), len(mss), {THREE.format(MIDDLE.format("mss"))},
         round((len(mss) + 1.0::DOUBLE) / (len(mss) + 2.0::DOUBLE) * ((ms - {MIDDLE.format("mss")}) / {NEED}) / (1.0 + (ms - {MIDDLE.format("mss")}) / {NEED}), 2)
  FROM w JOIN win USING (ord, kind) LEFT JOIN near n USING (ord, beh)
  WHERE len(mss) >= 2 AND ms - {MIDDLE.format("mss")} > {NEED} AND ms > list_max(mss) AND ms - {MIDDLE.format("mss")} > 2.0 * (list_max(mss) - list_min(mss))
    AND (class <> 'example' OR (coalesce(neighbour, 0.0) < 0.5 * slow AND (SELECT count(*) FROM slow z WHERE z.ord = w.ord AND z.slow >= 0.5 * n.slow) - 1 < 3))
    AND NOT coalesce((now - mid) - (total - list_aggregate(totals, 'median')) > total - list_aggregate(totals, 'median') AND (now - mid) - (total - list_aggregate(totals, 'median')) > 3.0 * 1.4826 * spread, FALSE)),
vals AS (SELECT s0.ord, s0.beh, s0.measure, scope, max(CASE WHEN cl.ord = s0.ord THEN CASE WHEN measure = 'count' THEN cl.n ELSE 0 END END) AS own, list(CASE WHEN measure = 'count' THEN cl.n::DOUBLE ELSE 0.0 END) FILTER (WHERE cl.ord < s0.ord) AS v
         FROM (SELECT DISTINCT ord, beh, measure FROM s0 WHERE measure IN ('count', 'queries')) s0 JOIN cl ON cl.beh = s0.beh AND cl.ord BETWEEN s0.ord - 10 AND s0.ord GROUP BY ALL
         UNION ALL SELECT DISTINCT s0.ord, s0.beh, measure, NULL, CASE WHEN measure = 'count' THEN loose ELSE q END, CASE WHEN measure = 'count' THEN looses ELSE qs END FROM s0 JOIN w USING (ord, beh) JOIN b USING (ord) WHERE class IN ('sql', 'request') AND measure IN ('count', 'queries') AND size > 0),
mid AS (SELECT ord, beh, measure, CASE WHEN scope IS NULL THEN 'setup' ELSE 'example:' || scope END AS scope, coalesce(own, 0) AS own, list_aggregate(list_concat(coalesce(v, []), list_transform(range(least(ord - 1, 10) - coalesce(len(v), 0)), lambda x: 0.0::DOUBLE)), 'median') AS middle FROM vals),
own AS (SELECT ord, beh, measure, max(scope) AS scope FROM mid WHERE own <> middle GROUP BY ALL HAVING count(*) = 1),
s1 AS (SELECT s0.*, class, tmpl, CASE WHEN class = 'example' THEN 'example:' || beh WHEN own.scope IS NOT NULL THEN own.scope WHEN class <> 'stderr' AND single THEN 'example:' || one END AS spot,
              CASE WHEN class <> 'example' THEN own.scope END AS scope,
              s0.kind = 'frequency' AND s0.measure = 'count' AND resized AND units >= 2 AND NOT ({FIRES.format("rates", "(cur::DOUBLE / size)")}) AS by_size
       FROM s0 JOIN w USING (ord, beh) JOIN b USING (ord) LEFT JOIN own USING (ord, beh, measure)),
s2 AS MATERIALIZED (SELECT ord, beh, kind, measure, current, base, present_in, median, confidence, scope, spot, class = 'example' AND kind IN ('new', 'disappeared') AS moved, split_part(tmpl, ' # ', 1) AS file,
              CASE WHEN coalesce(by_size, FALSE) OR coalesce(spot, '') = 'setup' THEN 5 WHEN kind = 'error' THEN 1 WHEN (kind = 'frequency' AND class = 'request') OR (kind = 'new' AND class = 'stderr') OR (kind = 'latency' AND class IN ('example', 'request')) THEN 2 WHEN kind = 'frequency' THEN 3 ELSE 4 END AS tier,
              CASE WHEN spot IS NOT NULL THEN '1:' || spot WHEN class = 'stderr' THEN '3:' || substr(tmpl, 1, 60) ELSE '4:' || beh END AS key FROM s1
       UNION ALL SELECT ord, '<behaviors past the cap>', 'incomplete', 'events_past_cap', past, least(ord - 1, 10), len(list_filter(pasts, lambda p: p > 0)), {MIDDLE.format("pasts")}, round((least(ord - 1, 10) + 1.0::DOUBLE) / (least(ord - 1, 10) + 2.0::DOUBLE), 2), NULL, NULL, FALSE, NULL, 1, '0' FROM b WHERE past > 0),
col AS (SELECT ord, 'example:' || beh AS spot, '2:' || kind || ':' || file AS key FROM s2 WHERE moved QUALIFY count(*) OVER (PARTITION BY ord, kind, file) > 1),
s3 AS (SELECT s2.* EXCLUDE (key), coalesce(col.key, s2.key) AS key, list_position(['incomplete', 'error', 'new', 'disappeared', 'frequency', 'latency'], kind) AS ko FROM s2 LEFT JOIN col USING (ord, spot)),
i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ord, key ORDER BY moved DESC, tier, confidence DESC, ko, beh, measure) AS place FROM s3),
h AS (SELECT ord, key, row_number() OVER (PARTITION BY ord ORDER BY tier, confidence DESC, ko, beh, measure) AS group_rank FROM i WHERE place = 1)
"""
)


@query(
    DETECTED
    + """SELECT run, beh AS behavior, kind, measure, CAST(current AS DOUBLE) AS current, CAST(base AS INT) AS baseline_runs, CAST(present_in AS INT) AS present_in, CAST(median AS DOUBLE) AS median, scope, confidence, CAST(tier AS INT) AS tier,
       key AS group_key, CAST(group_rank AS INT) AS group_rank, CAST(place AS INT) AS place, place = 1 AS head FROM i JOIN h USING (ord, key) JOIN r USING (ord)"""
)
def detected_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six kinds of signals of each day, by class, with owners, groups and ranks."""
    return detection.detect_runs(suite_stats(spark, sf_dir)).select("run", "behavior", "kind", "measure", "current", "baseline_runs", "present_in", "median", "scope", "confidence", "tier", "group_key", "group_rank", "place", "head")


@query(DETECTED + "SELECT run, beh AS behavior, kind, measure, scope, CAST(tier AS INT) AS tier, key AS group_key FROM s3 JOIN r USING (ord)")
def detected_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose the signals are: the scope that moved alone, what they are worth, and what they are grouped under."""
    return detection.detect_runs(suite_stats(spark, sf_dir)).select("run", "behavior", "kind", "measure", "scope", "tier", "group_key")


@query(DETECTED + "SELECT run, beh AS behavior, kind, measure, CAST(group_rank AS INT) AS group_rank, CAST(place AS INT) AS place FROM i JOIN h USING (ord, key) JOIN r USING (ord)")
def detected_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the groups of each run, and of the signals of each group."""
    return detection.detect_runs(suite_stats(spark, sf_dir)).select("run", "behavior", "kind", "measure", "group_rank", "place")


@query(DETECTED + "SELECT run, kind, count(*) AS signals, count(DISTINCT key) AS groups, count(*) FILTER (WHERE tier = 5) AS explained FROM s3 JOIN r USING (ord) GROUP BY ALL")
def detected_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many signals of each kind a day has, in how many groups, and how many of them setup or the suite's size explains."""
    found = detection.detect_runs(suite_stats(spark, sf_dir))
    return found.groupBy("run", "kind").agg(F.count("*").alias("signals"), F.count_distinct("group_key").alias("groups"), F.count_if(F.col("tier") == 5).alias("explained"))


@query(
    DETECTED
    + """, ex AS (SELECT DISTINCT ord, beh FROM s0),
vs AS (SELECT ex.ord, ex.beh, string_agg(CAST(coalesce(f.n, 0) AS VARCHAR), ',' ORDER BY o.ord) AS baseline FROM ex JOIN r o ON o.ord BETWEEN ex.ord - 10 AND ex.ord - 1 LEFT JOIN f ON f.ord = o.ord AND f.beh = ex.beh GROUP BY ALL),
sc AS (SELECT ex.ord, ex.beh, cl.scope, max(CASE WHEN cl.ord = ex.ord THEN cl.n END) AS own, list(cl.n::DOUBLE) FILTER (WHERE cl.ord < ex.ord) AS v FROM ex JOIN cl ON cl.beh = ex.beh AND cl.ord BETWEEN ex.ord - 10 AND ex.ord GROUP BY ALL),
mv AS (SELECT ord, beh, count(*) AS moved_scopes FROM sc
       WHERE coalesce(own, 0) <> list_aggregate(list_concat(coalesce(v, []), list_transform(range(least(ord - 1, 10) - coalesce(len(v), 0)), lambda x: 0.0::DOUBLE)), 'median') GROUP BY ALL),
mb AS (SELECT ord, key, string_agg(beh || ' ' || kind || ' ' || measure, ',' ORDER BY place) AS members FROM i GROUP BY ALL)
SELECT run, i.beh AS behavior, i.kind, i.measure, baseline, coalesce(moved_scopes, 0) AS moved_scopes, members
FROM i JOIN r USING (ord) JOIN mb USING (ord, key) JOIN vs ON vs.ord = i.ord AND vs.beh = i.beh LEFT JOIN mv ON mv.ord = i.ord AND mv.beh = i.beh WHERE i.kind <> 'incomplete'"""
)
def explained_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal with its values before, how many of its scopes moved, and the members of its group."""
    stats = suite_stats(spark, sf_dir)
    rows = explain.explained(stats, detection.detect_runs(stats)).where("kind <> 'incomplete'")
    values, members = F.transform("baseline", lambda x: x["count"].cast("string")), F.transform("members", lambda x: F.concat_ws(" ", x["behavior"], x["kind"], x["measure"]))
    return rows.select("run", "behavior", "kind", "measure", F.array_join(values, ",").alias("baseline"), "moved_scopes", F.array_join(members, ",").alias("members"))


@query()
def detected_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What later days say of every day's signals, each judged by the baseline of its own day."""
    stats = suite_stats(spark, sf_dir)
    return outcomes.judge(stats, detection.detect_runs(stats))
