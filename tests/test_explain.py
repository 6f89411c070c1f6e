"""Explanations of signals, from made-up facts: values, scopes, usage, members and lines."""

import json

from tidemark.operators import detection, explain

FACTS = "run_id string, behavior string, kind string, template string, count long, errors long, timed long, total_us long, measures map<string,double>, stream string, seq long"


def test_explained(spark):
    facts, cells, lines = [], [], []
    for k in range(4):
        n = 30 if k == 3 else 10
        facts += [(f"r{k}", "q", "log", "query", n, 0, 0, None, None, "stderr", 1), (f"r{k}", "u", "run.resources", "process resources", 1, 0, 0, None, {"user_ms": 100.0 + 50 * (k == 3)}, "resources", 1)]
        cells += [(f"r{k}", "q", "request:a", 5, None), (f"r{k}", "q", "request:b", n - 5, None)]
    facts.append(("r3", "w", "log", "warned", 2, 0, 0, None, None, "stderr", 9))
    cells.append(("r3", "w", "request:b", 2, None))
    lines = [("r1", "q", 0, "old"), ("r2", "q", 1, "later b"), ("r2", "q", 0, "later a"), ("r3", "w", 0, "warned now")]
    runs = spark.createDataFrame([(f"r{k}", "c", k, True) for k in range(4)], "run_id string, context string, started long, usable boolean")
    stats = detection.assemble(runs, spark.createDataFrame(facts, FACTS), spark.createDataFrame(cells, "run_id string, behavior string, scope string, count long, sums map<string,double>"))
    found = detection.detect_runs(stats).where("run_id = 'r3'")
    kept = spark.createDataFrame(lines, "run_id string, behavior string, position int, line string")
    rows = explain.explained(stats, found, kept).cache()
    got = {(r["behavior"], r["kind"]): r for r in rows.collect()}
    q, w = got["q", "frequency"], got["w", "new"]
    assert [(x["run"], x["count"]) for x in q["baseline"]] == [("r0", 10), ("r1", 10), ("r2", 10)] and [x["count"] for x in w["baseline"]] == [0, 0, 0]
    assert [tuple(x) for x in q["scopes"]] == [("request:b", 25, 5.0)] and q["moved_scopes"] == 1 and [tuple(x) for x in w["scopes"]] == [("request:b", 2, 0.0)]
    assert [tuple(x) for x in q["resources"]] == [("user_ms", 150.0, 100.0)]
    assert q["evidence"] == ["later a", "later b"] and w["evidence"] == ["warned now"]
    assert q["group_key"] == w["group_key"] and len(q["members"]) == 2 and q["members"] == w["members"]  # one scope owns both
    assert json.loads(explain.document(rows).where("behavior = 'w'").first()["document"])["moved_scopes"] == 1
