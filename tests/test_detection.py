"""Whole detection on suites made up here: each context is a few quiet runs and one that changes something."""

import json
import os
from collections import defaultdict
from functools import reduce

import pytest

from tidemark.operators import detection, interpret, outcomes
from tidemark.sources.lines import read_scenario
from tidemark.sources.scratch import materialise

LINES = "run_id string, feed int, stream string, seq long, line string, raw_len long"


class Run:
    """The lines of one run: a test runner's events, its log, stderr and stdout."""

    def __init__(self, context, number):
        self.id, self.rows, self.at, self.seqs = f"{context}-{number}", [], 0, defaultdict(int)

    def add(self, feed, stream, line):
        self.seqs[stream] += 1
        self.rows.append((self.id, feed, stream, self.seqs[stream], line, len(line.encode()) + 1))

    def event(self, **fields):
        self.add(2, "file:rspec-events", json.dumps(fields))

    def log(self, line):
        self.add(3, "file:log/test.log", line)
        self.at += len(line.encode()) + 1

    def suite(self, names, failed=(), slow=None, loads=None, defines=None, queries=None, errors=(), stop=None):
        """names as file:example; slow: ms by name; queries: how many of a kind each example makes; stop: ran only so many."""
        ran = names[:stop]
        self.event(event="start", expected=len(names) if loads is None else loads, defined=len(names) if defines is None else defines)
        for error in errors:
            self.event(event="error_outside_examples", context=f"An error occurred while loading {error}.", **{"class": "SyntaxError"}, message="broken")
        for name in ran:
            file, _, title = name.partition(":")
            of = {"id": f"./spec/{file}_spec.rb[{title}]", "log_offset": self.at}
            self.event(event="example_started", **of)
            for _ in range((queries or {}).get(name, 0)):
                self.log('  Item Load (0.5ms)  SELECT "items".* FROM "items" WHERE "items"."id" = $1  [["id", 1]]')
            bad = {"exception": {"class": "Boom", "message": "no"}} if name in failed else {}
            self.event(event="example", full_description=f"{file} {title}", file_path=f"./spec/{file}_spec.rb", status="failed" if bad else "passed", run_time=(slow or {}).get(name, 5.0) / 1e3, **bad, **(of | {"log_offset": self.at}))
        self.event(event="summary", duration=len(ran) / 100, examples=len(ran), failures=len(failed), pending=0, errors_outside_of_examples=len(errors))
        return self

    def say(self, stream, *lines):
        for line in lines:
            self.add({"stdout": 0, "stderr": 1}[stream], stream, line)
        return self


A, B = [f"a:a{i}" for i in range(1, 5)], [f"b:b{i}" for i in range(1, 7)]


def contexts():
    make = lambda c, *bodies: [body(Run(c, k)) for k, body in enumerate(bodies, 1)]
    three = lambda body: (body, body, body)
    clean = lambda r: r.suite(A)
    whole = lambda r: r.suite(A + B)
    out = {
        "quiet": make("quiet", *three(clean), clean),
        "grown": make("grown", *three(clean), lambda r: r.suite(A + B, failed=["a:a1"]).say("stderr", "DEPRECATION: old call at line 12")),
        "shrunk": make("shrunk", *three(lambda r: r.suite(A + B).say("stderr", "DEPRECATION: old")), lambda r: r.suite(A).say("stderr", *["DEPRECATION: old"] * 3)),
        "focus": make("focus", *three(whole), lambda r: r.suite(A + B, failed=["a:a1"]), lambda r: r.suite(A[:1], loads=1, defines=10), lambda r: r.suite(A + B, failed=["a:a1"])),
        "load": make("load", *three(whole), lambda r: r.suite(A + B, failed=["a:a1"]), lambda r: r.suite(B, errors=["./spec/a_spec.rb"]), whole, lambda r: r.suite(A + B, failed=["a:a1"])),
        "red": make("red", *three(lambda r: r.suite(A, failed=["a:a3"], stop=3)), lambda r: r.suite(A, failed=["a:a3"], stop=3).say("stderr", "DEPRECATION: old")),
        "more": make("more", *three(lambda r: r.suite(A, queries={"a:a1": 2, "a:a2": 2})), lambda r: r.suite(A, queries={"a:a1": 9, "a:a2": 2})),
        "slow": make("slow", *three(clean), lambda r: r.suite(A, slow={"a:a2": 900.0})),
        "stall": make("stall", *three(clean), lambda r: r.suite(A, slow={"a:a2": 900.0, "a:a3": 700.0})),
        "unread": make("unread", *three(lambda r: r.say("stdout", "ready")), lambda r: r.say("stdout", "ready").say("stderr", "warning: odd")),
        "cut": make("cut", *three(lambda r: r.say("stdout", *[f"step {c}" for c in "abcdefgh"])), lambda r: r.say("stdout", *[f"step {c}" for c in "abcdefghijklmnopqrstuvwxyz"[::-1]])),
    }
    # counts that grow with the suite, and one that does not
    hooks = lambda names, extra=0: lambda r: r.suite(names, queries={n: 1 for n in names} | {names[0]: 1 + extra})
    out["size"] = make("size", *three(hooks(A)), hooks(A + B))
    return out


@pytest.fixture(scope="module")
def found(spark):
    made = contexts()
    lines = spark.createDataFrame([row for runs in made.values() for r in runs for row in r.rows], LINES)
    runs = spark.createDataFrame([(r.id, c, k, True) for c, rs in made.items() for k, r in enumerate(rs)], "run_id string, context string, started long, usable boolean")
    streams = lines.where("run_id like 'unread%'").select("run_id", "stream").distinct()
    stats = detection.stats_of(materialise(interpret.interpret(lines), "events"), runs, streams, most_behaviors=16)
    got = materialise(detection.detect_runs(stats), "detected")
    by = defaultdict(list)
    for r in got.orderBy("run_id", "group_rank", "place").collect():
        by[r["run_id"]].append(r)
    return stats, got, by


def brief(rows):
    return [(r["kind"], r["measure"], r["current"], r["template"], r["group_rank"]) for r in rows]


def test_quiet_runs_say_nothing(found):
    by = found[2]
    assert not by["quiet-4"] and not by["unread-4"] and not any(r.endswith(("-1", "-2", "-3")) and by[r] for r in list(by) if not r.startswith("focus"))


def test_a_grown_suite_keeps_its_baseline_and_its_new_file_is_one_change(found):
    rows = found[2]["grown-4"]
    assert brief(rows)[:2] == [("error", "failed", 1.0, "./spec/a_spec.rb # a a1", 1), ("new", "count", 1.0, "DEPRECATION: old call at line <int>", 2)]
    assert {(r["kind"], r["group_rank"], r["group_key"]) for r in rows[2:]} == {("new", 3, "2:new:./spec/b_spec.rb")} and len(rows) == 8
    assert (rows[0]["exception"], rows[0]["confidence"], rows[0]["tier"], rows[0]["baseline_runs"], rows[0]["failures"]) == ("Boom", 0.8, 1, 3, 0)


def test_a_deleted_file_is_one_change_below_a_warning(found):
    rows = found[2]["shrunk-4"]
    assert brief(rows)[0] == ("frequency", "count", 3.0, "DEPRECATION: old", 1)
    assert {(r["kind"], r["group_rank"]) for r in rows[1:]} == {("disappeared", 2)} and len(rows) == 7


def test_a_focus_run_is_incomplete_only(found):
    stats, got, by = found
    assert [(r["kind"], r["measure"], r["current"], r["median"]) for r in by["focus-5"]] == [("incomplete", "examples", 1.0, 10.0)]
    votes = detection.votes(stats, got.where("run_id in ('focus-4', 'load-4') and kind = 'error'")).collect()
    assert sorted((r["run_id"], r["later"], r["firing"]) for r in votes) == [("focus-4", "focus-6", True), ("load-4", "load-6", False), ("load-4", "load-7", True)]
    verdicts = {r["run_id"]: (r["status"], r["resolved_in"], r["recurred_in"]) for r in outcomes.judge(stats, got.where("kind = 'error'")).collect()}
    assert verdicts["focus-4"] == ("open", None, None) and verdicts["load-4"] == ("recurred", "load-6", "load-7")


def test_a_file_that_does_not_load_is_named_once(found):
    assert [(r["kind"], r["measure"], r["template"]) for r in found[2]["load-5"]] == [("incomplete", "count", "./spec/a_spec.rb failed to load: SyntaxError: broken")]


def test_runs_that_stop_alike_are_compared(found):
    assert brief(found[2]["red-4"]) == [("new", "count", 1.0, "DEPRECATION: old", 1)]


def test_queries_are_owned_by_the_example_that_makes_them(found):
    rows = found[2]["more-4"]
    sql = next(r for r in rows if r["behavior_kind"] == "db.query")
    assert len({r["group_rank"] for r in rows}) == 1 and {(r["kind"], r["measure"], r["current"]) for r in rows} == {("frequency", "queries", 9.0), ("frequency", "count", 11.0)}
    assert (sql["scope"], sql["scope_baseline"], sql["scope_current"]) == (f"example:{next(r['behavior'] for r in rows if r['behavior_kind'] == 'test.example')}", 2.0, 9.0)


def test_a_slow_example_is_latency_but_a_stall_is_not(found):
    assert [(r["kind"], r["template"], r["current"]) for r in found[2]["slow-4"]] == [("latency", "./spec/a_spec.rb # a a2", 900.0)] and not found[2]["stall-4"]


def test_a_run_past_its_cap_says_so_and_judges_no_absence(found):
    rows = found[2]["cut-4"]
    assert [(r["kind"], r["measure"], r["current"]) for r in rows if r["kind"] != "new"] == [("incomplete", "events_past_cap", 10.0)] and {r["kind"] for r in rows} == {"incomplete", "new"}


def test_a_count_that_follows_the_suites_size_is_last(found):
    rows = found[2]["size-4"]
    sql = next(r for r in rows if r["behavior_kind"] == "db.query")
    assert (sql["kind"], sql["current"], sql["tier"], sql["median"]) == ("frequency", 10.0, 5, 4.0)


@pytest.mark.skipif(not os.environ.get("TIDEMARK_CAPTURES"), reason="TIDEMARK_CAPTURES names no folder of captured scenarios")
def test_captured_scenarios(spark):
    """Captures on disk, by the names of their folders: three quiet runs, then one; what must be found of it."""
    root, demo, hunt = os.environ["TIDEMARK_CAPTURES"], "rails_demo/", "rspec_hunt/"
    quiet = [demo + x for x in ("baseline", "baseline_2", "baseline_documentation")]
    cases = {
        "clean": (quiet, []), "n_plus_one": ([*quiet, demo + "n_plus_one"], [("frequency", "queries", 10.0), ("frequency", "count", 9.0), ("frequency", "queries", 35.0), ("disappeared", "count", 0.0)]),
        "fail": ([*quiet, demo + "fail"], [("error", "failed", 1.0)]), "slow": ([*quiet, demo + "slow"], [("latency", "duration_ms", 311.0)]), "warn": ([*quiet, demo + "warn"], [("new", "count", 1.0)] * 2),
        "ff": ([hunt + "ff10_fail"] * 3 + [hunt + "ff10_fail_warn"], [("new", "count", 1.0)]), "focus": ([hunt + "a10_clean"] * 3 + [hunt + "a10_fail", hunt + "a10_fail_focus"], [("incomplete", "examples", 1.0)]),
        "shrunk": ([hunt + "a20_warn1"] * 3 + [hunt + "a4_warn3"], [("frequency", "count", 3.0)] + [("disappeared", "count", 0.0)] * 16), "cargo": (["cargo_test/pass"] * 3 + ["cargo_test/fail"], [("error", "failed", 1.0)]),
    }
    parts = [read_scenario(spark, f"{root}/{d}", f"{c}-{k}") for c, (folders, _) in cases.items() for k, d in enumerate(folders)]
    lines = materialise(reduce(lambda a, b: a.unionByName(b), parts), "captures")
    runs = spark.createDataFrame([(f"{c}-{k}", c, k, True) for c, (folders, _) in cases.items() for k in range(len(folders))], "run_id string, context string, started long, usable boolean")
    stats = detection.stats_of(materialise(interpret.interpret(lines), "events"), runs)
    by = defaultdict(list)
    for r in detection.detect_runs(stats).orderBy("group_rank", "place").collect():
        by[r["run_id"]].append((r["kind"], r["measure"], r["current"]))
    for c, (folders, want) in cases.items():
        assert by[f"{c}-{len(folders) - 1}"] == want, c
