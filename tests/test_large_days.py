"""Days with very many signals, behaviors and lines: counted whole, and in steps that don't grow with pairs of runs."""

import datetime
import random
import re

import duckdb
import pytest

from tidemark.functions.redact import in_key_block, redact
from tidemark.operators import baseline, compare
from tidemark.registry import ORACLES, QUERIES


def day(d, i=0):
    return datetime.datetime(2024, 1, d, i % 24)


@pytest.fixture(scope="module")
def flood(spark, tmp_path_factory):
    """Two days of one user's examples, a third with 1,001 new ones, and a fourth without those."""
    folder = tmp_path_factory.mktemp("flood")
    rows = [(d, 1) for d in (1, 2, 3, 4)] + [(3, user) for user in range(100, 1101)]
    rows = [(i, day(d, i), user, "signup", 1.5, '{"k": 1}') for i, (d, user) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def wanted(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    out = con.execute(ORACLES[name])
    return [c[0] for c in out.description], sorted(out.fetchall())


@pytest.mark.parametrize("name", ["detected_kinds"])
def test_a_flood_is_counted(spark, flood, name):
    columns, want = wanted(flood, name)
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, flood).collect())
    assert got == want and max(r[columns.index("signals")] for r in got) == 1001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_count_is_shuffled_once_for_all_runs_that_it_is_a_baseline_of(spark):
    rng = random.Random(3)
    counts = {(r, b): rng.choice([None, 1, 2, 3]) for r in range(1, 31) for b in "abcd" if rng.random() < {"a": 1, "b": 0.5, "c": 0.1, "d": 0.05}[b]}
    runs = compare.numbered(spark.createDataFrame([("x", r) for r in range(1, 31)], "context string, run int"), "run")
    got = compare.wide(spark.createDataFrame([("x", r, b, v) for (r, b), v in counts.items()], "context string, run int, behavior string, count long"), runs, ["behavior"])
    want = set()
    for r in range(1, 31):
        for b in "abcd":
            near = [o for o in range(max(1, r - 10), r + 1) if (o, b) in counts]
            if near:
                now, vals = counts.get((r, b)), tuple(sorted(counts[o, b] for o in near if o < r and counts[o, b] is not None))
                want.add((r, b, now, now is not None, vals, len(vals)))
    rows = got.select("ord", "behavior", "current", "now", "vals", "present_in").collect()
    assert len(rows) == len(want) and {(o, b, c, now, tuple(v), k) for o, b, c, now, v, k in rows} == want
    plan = plan_of(got)
    assert re.search(r"hashpartitioning\(context#\d+, behavior#\d+", plan) and not re.search(r"hashpartitioning\(context#\d+, ord#\d+, behavior#\d+", plan)


def test_signals_are_found_once(spark, flood):
    """What ranks and counts them reads a written table, not the events again."""
    for name in ("ranked_signals", "signal_groups", "changes_report", "flood_refusal"):
        got = QUERIES[name](spark, flood)
        assert "events.parquet" not in plan_of(got)
        columns, want = wanted(flood, name)
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_equal_lines_are_normalized_once(spark, flood):
    got = QUERIES["rendered_templates"](spark, flood)
    plan = plan_of(got)
    assert plan.index("ArrowEvalPython") < re.search(r"hashpartitioning\(family#\d+, line#\d+, \d+\)", plan).start()  # plans are printed from the end
    columns, want = wanted(flood, "rendered_templates")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_examples_are_not_paired_where_summaries_settle_it(spark):
    """Without summaries nothing is asked of the examples, so no pair of runs meets them."""
    pairs = spark.createDataFrame([("c", "b", "a")], "case string, run_id string, candidate string")
    examples = spark.createDataFrame([("a", "x"), ("b", "x")], "run_id string, example string")
    none = spark.createDataFrame([], "run_id string, ran long, loaded long, defined long, errors_outside long")
    for got, want in ((baseline.judged(pairs, none, examples), [("c", "b", "a", None)]), (baseline.incomplete(pairs, none, examples), [])):
        assert [tuple(r) for r in got.collect()] == want
        assert "LeftSemi" in plan_of(got)  # pairs are cut down before they meet examples
    whole = spark.createDataFrame([("a", 1, 1, 1, 0), ("b", 1, 1, 1, 0)], none.schema)
    for got in (baseline.judged(pairs, whole, examples), baseline.incomplete(pairs, whole, examples)):
        assert all(r["reason"] is None for r in got.collect())


def test_lines_outside_of_keys_are_not_shuffled(spark):
    """A stream without a key's marks, and lines without findings, stay where they are; null keys are keys."""
    rows = [("r", 1, "a", 1, "mail x@example.org"), ("r", 1, "a", 2, "plain"), (None, 1, "b", 1, "-----BEGIN PRIVATE KEY-----"), (None, 1, "b", 2, "abc"), (None, 1, "b", 3, "-----END PRIVATE KEY-----"), ("r", 1, "c", 1, "abc"), ("r", 1, "c", 2, None)]
    df = spark.createDataFrame(rows, "run_id string, feed int, stream string, seq long, line string")
    got = in_key_block(df, ["run_id", "stream"])
    assert {(r["stream"], r["seq"]) for r in got.where("in_key").collect()} == {("b", 1), ("b", 2), ("b", 3)} and got.count() == 7
    kept = redact(df, "pii")
    assert {(r["stream"], r["seq"]): r["evidence"] for r in kept.where("stream <> 'b'").collect()} == {("a", 1): "mail <EMAIL_1>", ("a", 2): "plain", ("c", 1): "abc", ("c", 2): None}
    assert kept.count() == 7 and re.search("LeftAnti|LeftSemi", plan_of(got))
