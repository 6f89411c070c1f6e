import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outcomes
from tidemark.sources.store import Pruned, Store, report

B = "run_id string, behavior_id string, kind string, template string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    for k in (1, 2, 3):
        b = spark.createDataFrame([(f"r{k}", "abcd000000000000", "log", "x"), (f"r{k}", f"ef0{k}000000000000", "log", f"y{k}")], B)
        a = spark.createDataFrame([(f"r{k}", "abcd000000000000", k, "stdout" if k > 1 else None, 4 if k > 1 else None)], "run_id string, behavior_id string, count long, first_stream string, first_seq long")
        x = spark.createDataFrame([(f"r{k}", "abcd000000000000", 0, "stderr", 9, "password=hunter22 x")], "run_id string, behavior_id string, position int, stream string, seq long, line string")
        g = spark.createDataFrame([(f"r{k}", "abcd000000000000", "new", f"ef0{k}000000000000")], "run_id string, behavior_id string, kind string, scope_id string")
        s.begin({"run_id": f"r{k}", "context": "c", "started_at_ms": k})
        s.finish({"run_id": f"r{k}", "context": "c", "started_at_ms": k}, {"behaviors": b, "aggregates": a, "exemplars": x, "signals": g})
    s.begin({"run_id": "r4", "context": "c", "started_at_ms": 4})
    return s


def test_runs_exist_once_they_are_finished(store):
    assert sorted(r["run_id"] for r in store.runs().collect()) == ["r1", "r2", "r3"] and [r["run_id"] for r in store.unfinished().collect()] == ["r4"]
    assert [r["run_id"] for r in store.usable("c").collect()] == ["r3", "r2", "r1"] and store.counts() == {"runs": 3, "contexts": 1, "behaviors": 4}


def test_behaviors_are_written_once(spark, store):
    assert store.behaviors().count() == 4 and spark.read.parquet(f"{store.root}/behaviors").count() == 4


def test_joined_reads(store):
    got = {r["run_id"]: (r["count"], r["template"], r["first_stream"], r["first_seq"]) for r in store.stats().collect()}
    assert got == {"r1": (1, "x", "stderr", 9), "r2": (2, "x", "stdout", 4), "r3": (3, "x", "stdout", 4)}
    assert [(r["template"], r["scope_template"], r["kind"], r["behavior_kind"]) for r in store.signals(["r2"]).collect()] == [("x", "y2", "new", "log")]


def test_a_flood_is_counted_and_an_interrupted_run_keeps_none(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    many = spark.range(5).select(F.lit("r1").alias("run_id"), F.col("id").cast("string").alias("behavior_id"))
    s.finish({"run_id": "r1", "context": "c"}, {"signals": many}, most_signals=4)
    s.finish({"run_id": "r2", "context": "c", "interrupted": True}, {"signals": many})
    assert {r["run_id"]: r["uncompared"] for r in s.runs().collect()} == {"r1": 5, "r2": None}
    with pytest.raises(FileNotFoundError):
        s.table("signals")
    with pytest.raises(ValueError, match="no table"):
        s.finish({"run_id": "r3"}, {"other": many})


def test_scrub_and_notes(store):
    store.feedback([{"at_ms": 1, "kind": "acked", "signal_id": "s", "note": "token: ghp_" + "a1" * 15}])
    assert store.feedback_rows().first()["note"] == "token: <TOKEN>"
    for _ in range(2):
        store.scrub()
        assert {r["line"] for r in store.table("exemplars").collect()} == {"password=<SECRET> x"}
    assert store.table("exemplars", ["r1"]).count() == 1


def test_pruned_runs_raise_where_they_are_asked_for(spark, store):
    plan = outcomes.retention_plan(store.runs().select("context", F.col("run_id").alias("run"), F.timestamp_millis("started_at_ms").alias("started"), F.lit(False).alias("usable"), F.lit(False).alias("live"), F.lit(True).alias("has_stats"), F.lit(True).alias("has_evidence")), stats_runs=2, evidence_runs=1)
    assert store.prune(plan) == 2 and store.prune(plan) == 0
    assert [r["run_id"] for r in store.table("aggregates").orderBy("run_id").collect()] == ["r2", "r3"] and store.table("exemplars").count() == 1
    for name, run in (("aggregates", "r1"), ("signals", "r1"), ("exemplars", "r2")):
        with pytest.raises(Pruned):
            store.table(name, [run])
    with pytest.raises(LookupError, match="no finished run"):
        store.table("aggregates", ["r4"])
    assert [r["run_id"] for r in store.usable("c").collect()] == ["r3", "r2"] and store.counts()["runs"] == 3
    import os

    assert not os.path.exists(f"{store.root}/aggregates/run_id=r1") and not os.path.exists(f"{store.root}/exemplars/run_id=r2")


def test_report(spark):
    rows = [("c", "r", 1, 1, "b1", "error", "failed", 1.0, 0.8, 1), ("c", "r", 2, 1, "b2", "new", "count", 2.0, 0.8, 4), ("c", "r", 1, 2, "b3", "new", "count", 1.0, 0.7, 4)]
    got = report(spark.createDataFrame(rows, "context string, run string, group_rank int, place int, behavior string, kind string, measure string, current double, confidence double, tier int")).first()
    doc = json.loads(got["document"])
    assert doc["changes"] == 2 and [(g["head"], len(g["signals"])) for g in doc["groups"]] == [("b1", 2), ("b2", 1)]
