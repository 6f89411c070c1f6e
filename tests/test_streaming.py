"""First-seen behaviors in keyed state, and the sink of JSON lines."""

import json
import time

import pytest

from tidemark.operators import aggregate
from tidemark.streaming import first_seen, ndjson
from tidemark.streaming.ndjson import NdjsonWriter, Written


@pytest.fixture
def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, text):
        (tmp_path / "in" / name).write_text(text)

    def run(most, per_trigger=16):
        lines = first_seen.tail(spark, str(tmp_path / "in"), per_trigger)
        q = first_seen.first_seen(lines, str(tmp_path / "seen"), str(tmp_path / "cp"), most=most, until_end=True)
        q.awaitTermination()
        return q

    def seen():
        return sorted(r["template"] for r in first_seen.seen_before(spark, str(tmp_path / "seen")).collect())

    return put, run, seen, tmp_path


def test_cap_and_overflow_over_restarts(stream):
    put, run, seen, path = stream
    put("a.txt", "took 5ms\ntook 7ms\nother\n")
    run(3)
    assert seen() == ["other", "took <duration>"]
    put("b.txt", "took 9ms\n\nthird\n")
    run(3)
    assert seen() == ["other", "third", "took <duration>"]
    put("c.txt", "fourth\nother\n")
    put("d.txt", "fifth\n")
    run(3, per_trigger=1)
    assert seen() == [aggregate.OVERFLOW, "other", "third", "took <duration>"]
    put("e.txt", "sixth\nother\n")
    run(3)
    assert seen() == [aggregate.OVERFLOW, "other", "third", "took <duration>"]
    assert ndjson.finish(f"{path}/seen", {"lines": 9}) == {"lines": 9, "commits": 3, "complete": True}
    assert ndjson.finish(f"{path}/seen", {"lines": 10})["lines"] == 9


def test_triggers_leave_nothing_where_nothing_is_new(stream):
    """Many triggers over the same behaviors: files grow with behaviors, not with triggers."""
    put, run, seen, path = stream
    for i in range(12):
        put(f"{i}.txt", f"same {i}ms\n" + ("late\n" if i == 7 else "") * 50)
    q = run(100, per_trigger=1)
    assert seen() == ["late", "same <duration>"]
    assert len(q.recentProgress) >= 12
    assert len(list((path / "seen" / "commits").iterdir())) == 2 and len(list((path / "seen" / "rows").iterdir())) == 2


def test_a_killed_trigger_repeats_nothing(stream, monkeypatch):
    """The query dies after its commit is published and before Spark notes the batch; the batch is done again."""
    import os

    put, run, seen, path = stream
    put("a.txt", "one\ntwo\n")
    run(10)
    put("b.txt", "three\n")
    run(10)
    # as if the last batch had been published and not noted
    for f in (path / "cp" / "commits").iterdir():
        if f.name.strip(".").split(".")[0] == "1":
            os.remove(f)
    run(10)
    assert seen() == ["one", "three", "two"]
    assert sum(len(f.read_text().splitlines()) for f in (path / "seen" / "rows").iterdir() if f.suffix == ".json") == 3


def test_commits_name_files_once(tmp_path):
    w = NdjsonWriter(str(tmp_path))
    from pyspark.sql import Row

    one, none = w.write(iter([Row(a="é", b=1)])), w.write(iter([]))
    assert none == Written(None, 0) and ndjson.committed(str(tmp_path)) == []
    w.commit([one, none, None], 4)
    again = w.write(iter([Row(a="é", b=1)]))
    w.commit([again], 4)
    assert len(ndjson.committed(str(tmp_path))) == 1 and len(list((tmp_path / "rows").iterdir())) == 1
    lost = w.write(iter([Row(a="x", b=2)]))
    w.abort([lost], 5)
    assert [json.loads(line) for f in (tmp_path / "rows").iterdir() for line in f.read_text().splitlines()] == [{"a": "é", "b": 1}]


def test_forgotten_behaviors_make_room(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n")
    q = first_seen.first_seen(first_seen.tail(spark, str(tmp_path / "in")), str(tmp_path / "seen"), str(tmp_path / "cp"), most=1, forget_ms=2_000)
    rows = lambda: [r["template"] for r in first_seen.seen_before(spark, str(tmp_path / "seen")).collect()]
    try:
        def until(n):
            end = time.time() + 90
            while len(rows()) < n and time.time() < end:
                time.sleep(0.5)
            return rows()

        assert until(1) == ["one"]
        time.sleep(8)
        (tmp_path / "in" / "b.txt").write_text("two\n")
        assert until(2) == ["one", "two"]  # not past the cap: the first is forgotten
    finally:
        q.stop()
    with pytest.raises(ValueError):
        first_seen.first_seen(first_seen.tail(spark, str(tmp_path / "in")), "x", "y", until_end=True, forget_ms=1)
