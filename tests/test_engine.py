import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, baseline, compare, interpret, outcomes
from tidemark.operators.ranges import as_of, within
from tidemark.sources.lines import read_scenario, split_text
from tidemark.sources.store import Store


def test_lines_keep_places_and_lengths(spark):
    got = split_text(spark.createDataFrame([(1, "a\r\nbé\n\nlast"), (2, ""), (3, "x\n")], "k int, t string"), "t", ["k"]).orderBy("k", "seq")
    assert [tuple(r) for r in got.collect()] == [(1, 1, "a", 3), (1, 2, "bé", 4), (1, 3, "", 1), (1, 4, "last", 4), (3, 1, "x", 2)]


def test_quantiles_of_the_histogram(spark):
    e = spark.createDataFrame([("r", x) for x in (0, 3, 4, 100, 1000, 1001, 999_999)], "run_id string, duration_us long")
    b = {r[0]: r[1] for r in e.select("duration_us", aggregate.bucket(F.col("duration_us"))).collect()}
    assert b == {0: 0, 3: 3, 4: 8, 100: 26, 1000: 39, 1001: 39, 999_999: 79}
    q = aggregate.quantiles(e, ["run_id"]).first()
    assert (q["duration_count"], q["duration_total_us"], q["max_us"]) == (7, 1_002_107, 999_999) and abs(q["p50_us"] - 100) <= 15 and q["p95_us"] <= 999_999


def test_caps_fold_by_arrival_and_spare_summaries(spark):
    e = spark.createDataFrame([("r", f"b{i}", "test.example" if i == 4 else "log", i, 5, "failure") for i in range(5)], "run_id string, behavior_id string, kind string, arrival int, duration_us long, outcome string")
    got = {r["behavior_id"]: (r["n"], r["d"]) for r in aggregate.capped(e, 2).groupBy("behavior_id").agg(F.count("*").alias("n"), F.count("duration_us").alias("d")).collect()}
    assert got == {"b0": (1, 1), "b1": (1, 1), "b4": (1, 1), aggregate.OVERFLOW: (2, 0)}


def test_exemplars_are_the_first_and_a_fixed_sample(spark):
    e = spark.range(100).select(F.lit("r").alias("run_id"), F.lit("b").alias("behavior_id"), F.col("id").alias("arrival"), F.lit("stdout").alias("stream"), F.col("id").alias("seq"), F.col("id").cast("string").alias("line"))
    one, two = ([r["seq"] for r in aggregate.exemplars(x).orderBy("position").collect()] for x in (e, e.repartition(7)))
    assert one == two and one[:3] == [0, 1, 2] and len(one) == 8 and one == sorted(one)


def runs(spark, counts):
    rows = [("c", f"r{i:02d}", b, c) for i, day in enumerate(counts) for b, c in day.items()]
    a = spark.createDataFrame(rows, "context string, run string, behavior string, count long")
    return a, compare.numbered(a.select("context", "run").distinct(), "run")


def test_a_baseline_is_at_most_ten_runs(spark):
    a, r = runs(spark, [{"x": i} for i in range(13)])
    last = compare.wide(a, r, ["behavior"]).where("run = 'r12'").first()
    assert (last["n"], last["current"], last["vals"]) == (10, 12.0, [float(i) for i in range(2, 12)])
    assert compare.baselines(r).where("ord = 13").count() == 10


def test_new_gone_and_changed(spark):
    a, r = runs(spark, [{"x": 3, "old": 1}, {"x": 3, "old": 1}, {"x": 10, "fresh": 1}])
    w = compare.wide(a, r, ["behavior"])
    assert {(s["behavior"], s["kind"]) for s in compare.presence(w, ["behavior"]).collect()} == {("fresh", "new"), ("old", "disappeared")}
    f = compare.frequency(w, ["behavior"]).collect()
    assert [(s["behavior"], s["exact"], s["confidence"]) for s in f] == [("x", True, 0.75)]


def test_known_failures_are_no_news(spark):
    rows = [("c", "r1", "a", 1, ["E"]), ("c", "r2", "a", 1, ["E"]), ("c", "r1", "b", 0, []), ("c", "r2", "b", 1, ["E"]), ("c", "r1", "d", 1, ["X"]), ("c", "r2", "d", 1, ["E"])]
    s = spark.createDataFrame(rows, "context string, run string, behavior string, errors long, reasons array<string>")
    r = compare.numbered(s.select("context", "run").distinct(), "run")
    assert {(x["behavior"], x["confidence"]) for x in compare.errors(s, r, ["behavior"]).collect()} == {("b", 0.67), ("d", 0.33)}


def test_rank_puts_moved_first_and_orders_groups_by_heads(spark):
    rows = [("c", "r", "b1", "count", "new", 0.8, 4, "g1", False), ("c", "r", "b2", "count", "frequency", 0.7, 4, "g1", True), ("c", "r", "b3", "count", "error", 0.6, 1, "g2", False)]
    got = compare.ranked(spark.createDataFrame(rows, "context string, run string, behavior string, measure string, kind string, confidence double, tier int, group_key string, moved boolean"))
    assert {(x["behavior"], x["group_rank"], x["place"]) for x in got.collect()} == {("b3", 1, 1), ("b2", 2, 1), ("b1", 2, 2)}


def test_outcomes(spark):
    votes = [("s1", 1, True), ("s1", 2, False), ("s1", 3, True), ("s2", 1, False), ("s3", 1, True)]
    got = {r["id"]: (r["status"], r["resolved_in"], r["recurred_in"], r["recurrences"]) for r in outcomes.outcomes(spark.createDataFrame(votes, "id string, ord int, firing boolean"), ["id"]).collect()}
    assert got == {"s1": ("recurred", 2, 3, 1), "s2": ("resolved", 1, None, 0), "s3": ("open", None, None, 0)}


def test_eligibility(spark):
    tests = spark.createDataFrame([("now", 3, 3, 3, 0), ("all", 2, 2, 2, 0), ("stopped", 1, 3, 3, 0), ("errors", 1, None, None, 1)], "run_id string, ran long, loaded long, defined long, errors_outside long")
    examples = spark.createDataFrame([("now", x) for x in "abc"] + [("all", "a"), ("all", "b"), ("stopped", "a"), ("errors", "a")], "run_id string, example string")
    pairs = spark.createDataFrame([("now", c) for c in ("all", "stopped", "errors", "none")], "run_id string, candidate string")
    assert {r["candidate"]: r["reason"] for r in baseline.judged(pairs, tests, examples).collect()} == {"all": None, "stopped": "stopped", "errors": "errors_outside_examples", "none": "no_test_summary"}
    back = spark.createDataFrame([("stopped", "now"), ("now", "all")], "run_id string, candidate string")
    assert [(r["run_id"], r["reason"]) for r in baseline.incomplete(back, tests, examples).collect()] == [("stopped", "stopped")]


def test_ranges(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b")], "k int, at int, v string")
    assert {tuple(r) for r in as_of(left, right, ["k"], "at", ["v"]).collect()} == {(1, 5, "a"), (1, 9, "b"), (2, 1, None)}
    spans = spark.createDataFrame([(1, 0, 5, "p"), (1, 5, 25, "q"), (1, 7, 7, "none")], "k int, s int, e int, n string")
    assert {(r["at"], r["n"]) for r in within(left, spans, ["k"], "at", "s", "e", 4).collect()} == {(5, "q"), (9, "q")}
    assert {(r["at"], r["n"]) for r in within(left, spans, ["k"], "at", "s", "e", 4, closed=True).collect()} == {(5, "p"), (5, "q"), (9, "q")}


@pytest.fixture
def scenario(tmp_path):
    log = ["Started GET \"/u/1\" for ::1 at 2024-01-15 10:00:00 +0000", "Processing by UsersController#show as HTML", "  User Load (0.5ms)  SELECT 1 WHERE id = $1  [[\"id\", 1]]", "Completed 200 OK in 4ms (Views: 1ms)", "tail line 7"]
    text = "".join(x + "\n" for x in log)
    end = len("".join(x + "\n" for x in log[:4]).encode())
    events = [{"event": "start", "expected": 1, "defined": 1}, {"event": "example_started", "id": "./spec/a_spec.rb[1:1]", "log_offset": 0},
              {"event": "example", "id": "./spec/a_spec.rb[1:1]", "full_description": "A works", "file_path": "./spec/a_spec.rb", "status": "failed", "run_time": 0.25, "exception": {"class": "Boom", "message": "x"}, "log_offset": end},
              {"event": "summary", "duration": 0.3, "examples": 1, "failures": 1, "pending": 0, "errors_outside_of_examples": 0}]
    (tmp_path / "test.log").write_text(text)
    (tmp_path / "rspec.ndjson").write_text("".join(json.dumps(e) + "\n" for e in events))
    (tmp_path / "stdout.txt").write_text("test a::b ... ok\nERROR broke after 3 tries in 5ms\n")
    return str(tmp_path)


def test_replay(spark, scenario):
    e = interpret.interpret(read_scenario(spark, scenario, "r1")).cache()
    got = {(r["kind"], r["template"]): r for r in e.collect()}
    example = got["test.example", "./spec/a_spec.rb # A works"]
    assert (example["outcome"], example["duration_us"]) == ("failure", 250_000) and ("exception", "Boom") in got and ("test.example", "a::b") in got
    assert got["db.query", "User Load SELECT <int> WHERE id = ?"]["scope"] == "example:./spec/a_spec.rb # A works"
    assert got["http.request", "GET UsersController#show 2xx"]["measures"] == {"queries": 1.0}
    assert got["log", "tail line <int>"]["scope"] == "phase:teardown"
    assert got["log", "ERROR broke after <int> tries in <duration>"]["outcome"] == "failure"
    assert got["test.summary", "rspec"]["measures"] == {"examples": 1.0, "failures": 1.0, "pending": 0.0, "errors_outside_of_examples": 0.0, "expected": 1.0, "defined": 1.0}
    with pytest.raises(FileNotFoundError):
        read_scenario(spark, scenario + "/none", "r1")


def test_redaction_numbers_values_and_masks_keys(spark):
    from tidemark.functions.redact import redact

    key = ["-----BEGIN RSA PRIVATE KEY-----", "abc", "-----END RSA PRIVATE KEY-----"]
    text = ["use ghp_" + "a1" * 15 + " now", "password=hunter22 again ghp_" + "a1" * 15, *key, "password=[FILTERED] ok", "mail bob@example.com"]
    rows = spark.createDataFrame([("r", 0, "stdout", i + 1, t) for i, t in enumerate(text)], "run_id string, feed int, stream string, seq long, line string")
    got = [(r["evidence"], r["masked"]) for r in redact(rows).orderBy("seq").collect()]
    assert got[0] == ("use <TOKEN_1> now", "use <TOKEN> now") and got[1] == ("password=<SECRET_1> again <TOKEN_1>", "password=<SECRET> again <TOKEN>")
    assert all(m == "<SECRET>" for _, m in got[2:5]) and got[5][0] == text[5] and got[6][0] == text[6]
    assert redact(rows, "pii").where("seq = 7").first()["evidence"] == "mail <EMAIL_1>"
    assert redact(rows, "off").where("seq = 1").first()["evidence"] == text[0]


def test_store_publishes_last(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.runs().count() == 0
    b = spark.createDataFrame([("r1", "abcd000000000000", "log", "x")], "run_id string, behavior_id string, kind string, template string")
    s.finish({"run_id": "r1", "context": "c", "started_at_ms": 1}, {"behaviors": b})
    s.finish({"run_id": "r2", "context": "c", "started_at_ms": 2, "interrupted": True}, {"signals": b})
    assert [r["run_id"] for r in s.usable("c").collect()] == ["r1"] and s.resolve("abcd") == "abcd000000000000"
    with pytest.raises(LookupError):
        s.resolve("ffff")
    with pytest.raises(FileNotFoundError):
        s.table("signals")
    s.feedback([{"at_ms": 1, "kind": "acked", "signal_id": "s"}, {"at_ms": 2, "kind": "dismissed", "signal_id": "s"}])
    assert outcomes.judgement(s.feedback_rows()).first()["judgement"] == "wrong"


def test_sql_functions(spark):
    from tidemark.functions.ids import behavior_id
    from tidemark.functions.normalize import register

    register(spark)
    got = spark.sql("SELECT normalize_line('took 5ms of 2KB').template AS t, behavior_id('log', 'x') AS b, slot_value('duration', '2s') AS v, behavior_id(NULL, 'x') AS n").first()
    assert tuple(got) == ("took <duration> of <size>", behavior_id("log", "x"), 2000.0, None)
