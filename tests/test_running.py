"""States that can be added up, and the statistics of runs that grow."""

import json
import random

from pyspark.sql import functions as F

from tidemark.operators import aggregate
from tidemark.streaming import running

EVENT = "run_id string, behavior_id string, kind string, duration_us long, outcome string, arrival long"


def made(n):
    rng = random.Random(9)
    return [(f"r{rng.randrange(2)}", f"b{rng.randrange(9)}", "test.example" if rng.random() < 0.1 else "log", rng.choice([None, rng.randrange(5), rng.randrange(10**6)]), rng.choice([None, "failure", "success"]), i) for i in range(n)]


def whole(spark, rows, most):
    events = spark.createDataFrame(rows, EVENT).withColumn("arrival", F.struct("arrival"))
    return sorted(map(str, aggregate.behavior_stats(aggregate.capped(events, most), running.KEYS).collect()))


def test_states_of_any_parts_add_up(spark):
    rows = made(600)
    events = spark.createDataFrame(rows, EVENT).withColumn("arrival", F.struct("arrival"))
    parts = [aggregate.cells(events.where(F.col("arrival.arrival") % 3 == k), running.KEYS) for k in range(3)]
    left = aggregate.merged(aggregate.merged(parts[0].union(parts[1]), running.KEYS).union(parts[2]), running.KEYS)
    right = aggregate.merged(parts[0].union(aggregate.merged(parts[2].union(parts[1]), running.KEYS)), running.KEYS)
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))
    for most in (3, 100):
        assert sorted(map(str, aggregate.exact_once(aggregate.from_cells(aggregate.folded(left, most), running.KEYS)).collect())) == whole(spark, rows, most)


def test_a_stream_has_the_stats_of_its_lines(spark, tmp_path):
    rows, names = made(300), [f.split()[0] for f in EVENT.split(", ")]
    (tmp_path / "in").mkdir()
    assert running.stats_of(spark, f"{tmp_path}/state") is None
    for part in range(2):
        for k in range(5):
            mine = rows[part * 150 + k * 30 : part * 150 + k * 30 + 30]
            (tmp_path / "in" / f"{part}-{k}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in mine))
        running.running_stats(running.tail(spark, f"{tmp_path}/in", EVENT, 1), f"{tmp_path}/state", f"{tmp_path}/cp", until_end=True, every=3).awaitTermination()
        assert sorted(map(str, running.stats_of(spark, f"{tmp_path}/state", 4).collect())) == whole(spark, rows[: 150 * (part + 1)], 4)
    there = sorted(p.name for p in (tmp_path / "state").iterdir())
    assert there == ["batch=6", "batch=7", "batch=8", "batch=9", "upto=5", "upto=8"]  # not a folder a trigger
