from pyspark.sql import functions as F

from tidemark.operators import compare, detect


def test_classes(spark):
    rows = [("test.summary", "x", "stdout"), ("test.example", "x", "stdout"), ("db.query", "TRANSACTION BEGIN", "f"), ("db.query", "User Load", "f"), ("log", "x", "stderr"), ("log", "x", "stdout")]
    df = spark.createDataFrame(rows, "kind string, template string, stream string")
    of = lambda reporter: [r[0] for r in df.select(detect.behavior_class(F.col("kind"), F.col("template"), F.col("stream"), F.lit(reporter), F.lit(False))).collect()]
    assert of(True) == [None, "example", None, "sql", "stderr", None] and of(False)[-1] == "output"


def test_the_only_scope_that_moved_owns_the_change(spark):
    rows = [("c", r, "b", s, n) for r, ns in (("r1", (1, 2)), ("r2", (1, 2)), ("r3", (9, 2))) for s, n in zip("xy", ns, strict=True)] + [("c", "r3", "z", None, 1), ("c", "r3", "z", "x", 1)]
    s = spark.createDataFrame(rows, "context string, run string, behavior string, scope_id string, count long")
    runs = compare.numbered(s.select("context", "run").distinct(), "run")
    got = detect.owners(s, runs, ["behavior"]).collect()
    assert [(r["run"], r["behavior"], r["owner"], r["owner_current"], r["owner_median"]) for r in got] == [("r3", "b", "x", 9.0, 1.0)]
    assert detect.sole_scope(s.where("scope_id = 'y'"), runs, ["behavior"]).count() == 3


def test_examples_of_a_file_collapse(spark):
    rows = [("c", "r", "new", e, "1:example:" + e, e, f, True) for e, f in (("e1", "a"), ("e2", "a"), ("e3", "b"))] + [("c", "r", "frequency", "q", "1:example:e1", "e1", None, False), ("c", "r", "error", "e4", "1:example:e4", "e4", "a", False)]
    got = detect.collapse(spark.createDataFrame(rows, "context string, run string, kind string, behavior string, group_key string, example string, file string, moved boolean"))
    assert {r["behavior"]: r["group_key"] for r in got.collect()} == {"e1": "2:new:a", "e2": "2:new:a", "q": "2:new:a", "e3": "1:example:e3", "e4": "1:example:e4"}


def test_partial_runs_say_less(spark):
    found = spark.createDataFrame([("c", "r", k, s) for k, s in (("latency", ["a"]), ("disappeared", ["a"]), ("disappeared", ["b"]), ("new", ["u"]), ("new", ["a"]))], "context string, run string, kind string, scopes array<string>")
    one = spark.createDataFrame([("c", "r", ["a"])], "context string, run string, examples array<string>")
    kept = detect.partial_filters(found, one.select("context", "run"), one, spark.createDataFrame([("c", "r", ["u"])], "context string, run string, unrun array<string>"))
    assert sorted((r["kind"], r["scopes"][0]) for r in kept.collect()) == [("disappeared", "a"), ("new", "a")]


def test_explain(spark):
    a = spark.createDataFrame([("c", "r1", "x", 2), ("c", "r3", "x", 9)], "context string, run string, behavior string, count long")
    runs = compare.numbered(spark.createDataFrame([("c", f"r{i}") for i in (1, 2, 3)], "context string, run string"), "run")
    lines = spark.createDataFrame([("c", "r3", "x", 0, "now"), ("c", "r1", "x", 0, "then")], "context string, run string, behavior string, position int, line string")
    got = detect.explain(a.where("run = 'r3'").select("context", "run", "behavior"), a, runs, lines).first()
    assert [(b["base_run"], b["count"]) for b in got["baseline"]] == [("r1", 2), ("r2", 0)] and got["evidence"] == ["now"]
