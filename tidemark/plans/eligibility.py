"""Which days may be compared with which, each day as a run of a test suite: its users that signed up are its examples.

Every fifth day stops before its last example, every seventh leaves one out, every eleventh has errors outside examples, and
every thirteenth has no summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, compare
from ..registry import query
from .telemetry import DAYS, day_events, day_runs


def suites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of a day and each of the ten before it, sums of the summaries, examples)."""
    e = day_events(spark, sf_dir)
    examples = e.where("event_type = 'signup'").select(F.col("run").alias("run_id"), F.col("user_id").cast("string").alias("example")).distinct()
    day = F.dayofmonth(F.to_date("run_id"))
    every = lambda n: (day % n == 0).cast("long")
    ran = e.select(F.col("run").alias("run_id")).distinct().join(examples.groupBy("run_id").agg(F.count("*").alias("examples")), "run_id", "left").na.fill(0, ["examples"])
    said = ran.where(day % 13 != 0).withColumns({"expected": F.col("examples") + every(5), "defined": F.col("examples") + every(5) + every(7), "errors_outside_of_examples": every(11)})
    runs = day_runs(e)
    of = runs.select("context", F.col("run").alias("candidate"), F.col("ord").alias("base_ord"))
    pairs = compare.baselines(runs).join(runs.select("context", "ord", F.col("run").alias("run_id")), ["context", "ord"]).join(of, ["context", "base_ord"]).select("run_id", "candidate")
    return pairs, baseline.tests(said), examples


JUDGED = (
    DAYS
    + """, x AS (SELECT DISTINCT ord, user_id FROM e JOIN r USING (run) WHERE event_type = 'signup'),
z AS (SELECT ord, run, CAST(substr(run, 9, 2) AS INT) AS d, (SELECT count(*) FROM x WHERE x.ord = r.ord) AS ran FROM r),
t AS (SELECT ord, ran, ran + CAST(d % 5 = 0 AS INT) AS loaded, ran + CAST(d % 5 = 0 AS INT) + CAST(d % 7 = 0 AS INT) AS defined, CAST(d % 11 = 0 AS INT) AS errors FROM z WHERE d % 13 <> 0),
p AS (SELECT c.ord, b.ord AS base FROM r c JOIN r b ON b.ord BETWEEN c.ord - 10 AND c.ord - 1),
ex AS (SELECT DISTINCT p.ord, a.user_id FROM p JOIN x a ON a.ord = p.ord JOIN x b ON b.ord = p.base AND a.user_id = b.user_id),
k AS (SELECT p.ord, p.base, count(*) FILTER (WHERE ex.user_id IS NOT NULL AND b.user_id IS NULL) > 0 AS lacks FROM p LEFT JOIN ex ON ex.ord = p.ord LEFT JOIN x b ON b.ord = p.base AND b.user_id = ex.user_id GROUP BY ALL),
j AS (SELECT k.ord, k.base, CASE WHEN now.ord IS NULL THEN NULL WHEN was.ord IS NULL THEN 'no_test_summary'
             WHEN (was.errors = 0 AND was.ran = was.loaded AND was.loaded = was.defined) OR NOT lacks THEN NULL WHEN was.errors > now.errors THEN 'errors_outside_examples' WHEN was.ran < was.loaded THEN 'stopped' ELSE 'subset' END AS reason
      FROM k LEFT JOIN t now ON now.ord = k.ord LEFT JOIN t was ON was.ord = k.base),
g AS (SELECT ord, base FROM j WHERE reason IS NULL)
"""
)


@query(JUDGED + "SELECT a.run, b.run AS candidate, reason FROM j JOIN r a ON a.ord = j.ord JOIN r b ON b.ord = j.base")
def judged_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a day is no baseline of a later one; null where it is."""
    return baseline.judged(*suites(spark, sf_dir)).withColumnRenamed("run_id", "run")


@query(
    JUDGED
    + """, m AS (SELECT DISTINCT g.ord FROM g JOIN x b ON b.ord = g.base LEFT JOIN x a ON a.ord = g.ord AND a.user_id = b.user_id WHERE a.user_id IS NULL),
s AS (SELECT g.ord, count(*) AS n, count(t.ord) AS told, coalesce(max(t.errors), 0) AS errors FROM g LEFT JOIN t ON t.ord = g.base GROUP BY g.ord),
i AS (SELECT s.ord, s.n, CASE WHEN t.ord IS NULL THEN CASE WHEN n = told THEN 'no_test_summary' END WHEN m.ord IS NULL THEN NULL WHEN t.errors > s.errors THEN 'errors_outside_examples' WHEN t.ran < t.loaded THEN 'stopped' WHEN t.loaded < t.defined THEN 'subset' END AS reason
      FROM s LEFT JOIN t USING (ord) LEFT JOIN m USING (ord))
SELECT run, n, reason FROM i JOIN r USING (ord) WHERE reason IS NOT NULL"""
)
def incomplete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that did not run what their baseline did, and why."""
    pairs, tests, examples = suites(spark, sf_dir)
    taken = baseline.judged(pairs, tests, examples).where("reason is null").drop("reason")
    return baseline.incomplete(taken, tests, examples).withColumnRenamed("run_id", "run")


@query(JUDGED + "SELECT run, bool_and(coalesce(t.errors > 0 OR t.ran < t.loaded OR t.loaded < t.defined, FALSE)) AS partial FROM p JOIN r USING (ord) LEFT JOIN t ON t.ord = p.base GROUP BY run")
def partial_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of the ten days before a day skipped examples that exist."""
    pairs, tests, _ = suites(spark, sf_dir)
    return baseline.partial(pairs, tests).withColumnRenamed("run_id", "run")
