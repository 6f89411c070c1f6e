from pyspark.sql import functions as F

from tidemark.functions import commands
from tidemark.operators import compare, detect, reads
from tidemark.sources import segments


def test_offsets_move_into_the_kept_log(spark):
    parts = spark.createDataFrame([("r", 1, 7, 100, 150), ("r", 2, 8, 0, 30)], "run_id string, place int, ino long, from long, to long")
    at = lambda offset, ino: f'{{"event":"x","log_offset":{offset},"log_ino":{ino}}}'
    rows = [("r", 1, at(150, 7)), ("r", 2, at(10, 8)), ("r", 3, at(99, 7)), ("r", 4, '{"event":"x"}'), ("q", 1, at(1, 7)), ("r", 5, at("x", 7))]
    got = {(r["run_id"], r["seq"]): r["line"] for r in segments.rebase(spark.createDataFrame(rows, "run_id string, seq long, line string"), parts).collect()}
    assert got == {("r", 1): '{"event":"x","log_offset":50}', ("r", 2): '{"event":"x","log_offset":60}', ("r", 3): '{"event":"x"}', ("r", 4): '{"event":"x"}', ("q", 1): '{"event":"x"}', ("r", 5): at("x", 7)}
    top = spark.createDataFrame([(1, "# Logfile created on 2025"), (2, "# Logfile created on 2025"), (3, "x")], "seq long, line string")
    assert segments.without_header(top).count() == 2


def test_suites(spark):
    rows = ["rspec a", "bundle exec rspec", "bundle install", "bin/rails test:models", "rake spec", "rake specs", "rails server", "make test", "bundle", "rails", ""]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    assert [r[0] for r in df.select(commands.suite(F.split("c", " "))).collect()] == ["rspec", "rspec", None, "other", "rspec", None, None, None, None, None, None]


def test_jobs(spark):
    rows = ["# a", "PATH=/bin", "", "*/5 * * * *  /bin/a b", "@daily  FOO=1 run", "0 1 * * 1 echo 'x' | y", "0 1 * *"]
    got = [(r["schedule"], r["user"], r["command"], r["wrapped"]) for r in commands.jobs(spark.createDataFrame([(r,) for r in rows], "line string"), program="p").collect()]
    assert got == [
        ("*/5 * * * *", None, "/bin/a b", "*/5 * * * * p --quiet-unless-changed -- /bin/a b"), ("@daily", None, "FOO=1 run", "@daily p --quiet-unless-changed -- sh -c 'FOO=1 run'"),
        ("0 1 * * 1", None, "echo 'x' | y", "0 1 * * 1 p --quiet-unless-changed -- sh -c 'echo '\\''x'\\'' | y'"),
    ]
    one = commands.jobs(spark.createDataFrame([("@reboot root run",)], "line string"), True, "p").first()
    assert (one["user"], one["wrapped"]) == ("root", "@reboot root p --quiet-unless-changed -- run")


def test_nearest_names(spark):
    df = spark.createDataFrame([("histry",), ("rn",), ("zzzz",), ("gc",)], "w string")
    assert [r[0] for r in df.select(commands.nearest(F.col("w"), ["run", "history", "gc"])).collect()] == ["history", "run", None, "gc"]


def test_history_and_whole_lines(spark):
    runs = spark.createDataFrame([("c", "r1", True, False, 0), ("c", "r2", True, None, 0), ("c", "r3", True, False, 4), ("c", "r4", False, True, 0)], "context string, run string, finished boolean, interrupted boolean, events_past_cap long")
    signals = spark.createDataFrame([("c", "r1", "g", 3, "new"), ("c", "r1", "g", 5, "new"), ("c", "r1", "h", 5, "new"), ("c", "r2", "0", 1, "incomplete")], "context string, run string, group_key string, tier int, kind string")
    got = {r["run"]: (r["changes"], r["signals"], r["complete"]) for r in reads.history(runs, signals).collect()}
    assert got == {"r1": (1, 3, True), "r2": (1, 1, False), "r3": (0, 0, False), "r4": (0, 0, False)}
    assert [r["run"] for r in reads.runs_after(runs, "c", "r1").collect()] == ["r2", "r3"]
    kept = spark.createDataFrame([("r", reads.EVENTS, 1, "he"), ("r", reads.EVENTS, 2, "wo"), ("r", "stdout", 1, "x")], "run_id string, stream string, seq long, line string")
    lines = reads.whole_lines(kept, kept.where("seq = 1").withColumn("line", F.concat("line", F.lit("llo")))).collect()
    assert {(r["stream"], r["seq"]): r["event"] for r in lines} == {(reads.EVENTS, 1): "hello", (reads.EVENTS, 2): "wo", ("stdout", 1): None}
    streams = spark.createDataFrame([("r1", "stdout"), ("r1", "a")], "run string, stream string")
    assert {r["run"]: r["streams"] for r in reads.sources_of(runs, streams).collect()}["r1"] == ["a", "stdout"]


def test_neighbour_context(spark):
    rows = [("make test", f"r{i}", i, "make test", True) for i in range(3)] + [("make lint all", "r4", 4, "make lint all", True), ("make test fast", "r5", 5, "x", True), ("make test slow", "r6", 6, "x", False)]
    got = reads.neighbour_context(spark.createDataFrame(rows, "context string, run string, started int, command string, usable boolean"), "make test fast").first()
    assert (got["context"], got["command"], got["runs"], got["shared"]) == ("make test", "make test", 3, 2)
    assert reads.neighbour_context(spark.createDataFrame(rows[:1], "context string, run string, started int, command string, usable boolean"), "make test").count() == 0


def test_classes_choose_rules(spark):
    kinds = {"e": "example", "q": "request", "s": "sql", "none": None}
    counts = spark.createDataFrame([("c", f"r{i}", b, 9 if i == 3 else 1) for i in (1, 2, 3) for b in kinds] + [("c", "r3", "e2", 1)], "context string, run string, behavior string, count long")
    runs = compare.numbered(counts.select("context", "run").distinct(), "run")
    classes = spark.createDataFrame([("c", b, k) for b, k in kinds.items()] + [("c", "e2", "example")], "context string, behavior string, class string")
    requests = counts.where("behavior = 'q'").withColumn("queries", F.col("count") * 2)
    queries = spark.createDataFrame([("c", "r3", "e", 7)], "context string, run string, behavior string, queries long")
    errors = spark.createDataFrame([("c", "r3", b, 1, 0.75) for b in ("e", "s")], "context string, run string, behavior string, current long, confidence double")
    said = lambda gaps: {(r["behavior"], r["kind"], r["measure"], r["current"]) for r in detect.dispatch(counts, classes, runs, requests, queries, spark.createDataFrame(gaps, "context string, run string"), errors).collect()}
    some = {("e2", "new", "count", 1.0), ("q", "frequency", "count", 9.0), ("q", "frequency", "queries", 18.0), ("s", "frequency", "count", 9.0), ("e", "error", "errors", 1.0)}
    assert said([]) == some | {("e", "frequency", "queries", 7.0)} and said([("c", "r1")]) == some
