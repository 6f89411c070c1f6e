"""Commits of the store: run ids of any form, writes that fail in turn, two writers, and a run recorded in one call."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ids import behavior_ids
from tidemark.operators import detection, record
from tidemark.operators.interpret import generic
from tidemark.sources import scratch
from tidemark.sources.lines import split_text
from tidemark.sources.store import Store

IDS = ["007", "12e4", "2024-01-01", "true", "a/b=c %d"]


def small(spark, run):
    b = spark.createDataFrame([("abcd000000000000", "log", "x"), (f"{abs(hash(run)):016x}", "log", run)], "behavior_id string, kind string, template string")
    x = spark.createDataFrame([("abcd000000000000", 0, "stderr", 9, f"password=hunter22 {run}")], "behavior_id string, position int, stream string, seq long, line string")
    return {"behaviors": b, "exemplars": x, "aggregates": b.select("behavior_id", F.lit(1).alias("count"))}


def seen(store):
    """All that readers are told."""
    out = [sorted(map(str, store.runs().select("run_id", "stats_pruned", "evidence_pruned").collect()))]
    for name in ("exemplars", "aggregates"):
        try:
            out.append(sorted(map(str, store.table(name).collect())))
        except FileNotFoundError:
            out.append(None)
    out.append(sorted(map(str, store.feedback_rows().collect())))
    return out


def test_run_ids_of_any_form(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for k, run in enumerate(IDS):
        s.finish({"run_id": run, "context": "c", "started_at_ms": k}, small(spark, run))
    s.scrub()
    assert sorted(r["run_id"] for r in s.table("exemplars").collect()) == sorted(IDS)
    for run in IDS:
        row = s.table("exemplars", [run]).first()
        assert row["run_id"] == run and row["line"] == f"password=<SECRET> {run}"
    assert s.prune(spark.createDataFrame([("007", "stats"), ("12e4", "evidence")], "run string, action string")) == 2
    assert sorted(r["run_id"] for r in s.table("exemplars").collect()) == sorted(IDS[2:]) and s.table("aggregates").count() == 8
    assert s.behaviors().count() == 6 and s.vacuum() == 0


def test_every_write_that_fails_leaves_a_whole_store(spark, tmp_path, monkeypatch):
    """Each step in turn is lost before or after each of its writes; readers see the store before it or after it."""
    s = Store(spark, str(tmp_path))
    s.finish({"run_id": "r0", "context": "c", "started_at_ms": 0}, small(spark, "r0"))
    s.feedback([{"at_ms": 1, "kind": "acked", "note": "fine"}])
    plan = spark.createDataFrame([("r0", "evidence")], "run string, action string")
    steps = {"finish": lambda: s.finish({"run_id": "r1", "context": "c", "started_at_ms": 1}, small(spark, "r1")), "scrub": s.scrub, "feedback": lambda: s.feedback([{"at_ms": 2, "kind": "acked"}]), "prune": lambda: s.prune(plan)}

    class Lost(Exception):
        pass

    def lossy(f, at, calls):
        def run(*a, **k):
            calls.append(f.__name__)
            if len(calls) == at:
                raise Lost
            return f(*a, **k)

        return run

    for name, step in steps.items():
        before, at = seen(s), 0
        while True:
            at += 1
            calls = []
            with monkeypatch.context() as m:
                for method in ("_put", "_publish", "_delete"):
                    m.setattr(Store, method, lossy(getattr(Store, method), at, calls))
                try:
                    step()
                    break
                except Lost:
                    published = "_publish" in calls[:-1]
            assert (seen(s) != before) == published, (name, calls)
            if published:
                break
        assert seen(s) != before
    assert s.vacuum() > 0
    assert s.vacuum() == 0 and s.runs().count() == 2


def test_two_writers_take_two_numbers(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.begin({"run_id": "a", "context": "c"})
    stale = one._names(f"{one.root}/log")
    real, asked = Store._names, []

    def names(self, path):
        asked.append(path)
        return stale if len(asked) == 1 else real(self, path)

    two.begin({"run_id": "b", "context": "c"})
    monkeypatch.setattr(Store, "_names", names)  # the first look is from before the other's commit
    one.begin({"run_id": "c", "context": "c"})
    monkeypatch.setattr(Store, "_names", real)
    assert sorted(r["run_id"] for r in one.unfinished().collect()) == ["a", "b", "c"]
    assert sorted(n for n in one._names(f"{one.root}/log") if n[0] != ".") == [f"{k:012d}.json" for k in (1, 2, 3)]


def run_lines(spark, k):
    text = "".join(f"step {i} took {5 + i}ms\n" for i in range(3)) + "steady\n" * 4 + ("ERROR boom password=abcdef123456\n" * 9 if k == 3 else "ERROR boom password=abcdef123456\n") + ("odd one out\n" if k == 3 else "")
    return split_text(spark.createDataFrame([(f"r{k}", 0, "stdout", text)], "run_id string, feed int, stream string, text string"), "text", ["run_id", "feed", "stream"])


def test_record_compares_with_stored_runs(spark, tmp_path):
    """A run that is recorded beside stored ones gets the signals that the events of all runs together give."""
    s, ids = Store(spark, str(tmp_path)), ["r1", "r2", "r3"]
    both = run_lines(spark, 1).unionByName(run_lines(spark, 2)).withColumn("line", F.regexp_replace("line", "abcdef123456", "<SECRET>"))
    events = generic(both).withColumns({"behavior_id": behavior_ids("kind", "template"), "scope_id": F.lit(None).cast("string"), "arrival": F.struct("feed", "seq", "kind")})
    runs = spark.createDataFrame([(r, "c", k, True) for k, r in enumerate(ids[:2])], "run_id string, context string, started long, usable boolean")
    stats = detection.stats_of(events, runs, both.select("run_id", "stream").distinct())
    for k, r in enumerate(ids[:2]):
        s.finish({"run_id": r, "context": "c", "started_at_ms": k}, {t: df.where(F.col("run_id") == r) for t, df in (("run_sources", stats.runs), ("facts", stats.facts), ("cells", stats.cells))})
    record.record(s, {"run_id": "r3", "context": "c", "started_at_ms": 2}, run_lines(spark, 3).drop("run_id"))
    template = {r["behavior_id"]: r["template"] for r in s.behaviors().collect()}
    got = {(template[r["behavior_id"]], r["kind"], r["measure"], r["current"], r["median"], r["tier"], r["group_rank"]) for r in s.table("signals", ["r3"]).collect()}
    assert got == {("odd one out", "new", "count", 1.0, None, 4, 2), ("ERROR boom password=<SECRET>", "frequency", "count", 9.0, 1.0, 3, 1)}
    kept = {r["line"] for r in s.table("exemplars").collect()}
    assert "ERROR boom password=<SECRET_1>" in kept and not any("abcdef123456" in x for x in kept)
    assert s.runs().where("run_id = 'r3'").first()["lines"] == 17
    assert not [p for p in scratch.WRITTEN.get(spark.sparkContext.applicationId, []) if p.rsplit("/", 1)[-1].startswith(("events-", "lines-"))]
