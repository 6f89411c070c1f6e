"""Folds over slices of one long sequence, against windows and plain loops; and what is built on them."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.redact import EMAIL, in_key_block, redact
from tidemark.operators import interpret
from tidemark.operators.ranges import as_of
from tidemark.operators.scans import Fold, by_quantiles, by_width, ranked, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(None if k % 9 == 0 else "hot" if k % 3 else f"k{k % 4}", i, rng.choice([None, *range(-5, 6)]), rng.choice([None, "a", "b"])) for i, k in enumerate(rng.randrange(1000) for _ in range(700))]
    return spark.createDataFrame(data, "k string, seq long, v long, s string").repartition(5).cache()


@pytest.mark.parametrize("cut", ["width", "quantiles", "one"])
def test_folds_are_what_windows_give(rows, cut):
    slice_ = {"width": lambda: by_width("seq", 23), "quantiles": lambda: by_quantiles(rows, "seq", 16), "one": lambda: F.lit(0)}[cut]()
    folds = {f"{kind}_{c}_{before}": Fold(kind, F.col(c), before) for kind in ("sum", "last", "first", "max", "min") for c in ("v", "s") for before in (False, True) if not (kind == "sum" and c == "s")}
    got = scan(rows, ["k"], ["seq"], folds, slice_)
    w = Window.partitionBy("k").orderBy("seq")
    want = rows.withColumns({n: f.upto(f.value).over(w.rowsBetween(Window.unboundedPreceding, -1 if f.before else 0)) for n, f in folds.items()})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert scan(rows.limit(0), ["k"], ["seq"], folds, by_width("seq", 23)).count() == 0
    with pytest.raises(ValueError):
        Fold("median", F.col("v"))


def test_a_hot_key_is_many_groups(rows):
    """No group of the last window holds more than a slice and what is carried into it."""
    got = ranked(rows.withColumn("one", F.lit(1)), ["one"], ["seq"], "n", by_width("seq", 50))
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 701))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[.*\], \[one#\d+, _slice#", plan)


def test_as_of_with_one_key(spark):
    rng = random.Random(6)
    left = [(1, rng.randrange(300), i) for i in range(200)] + [(None, 5, 900), (2, 5, 901)]
    right = [(1, t, t * 10) for t in rng.sample(range(300), 60)] + [(None, 2, 7)]
    got = as_of(spark.createDataFrame(left, "k int, at long, i int"), spark.createDataFrame(right, "k int, at long, v long"), ["k"], "at", ["v"], slices=8)
    want = {(k, t, i, max(((x, v) for kk, x, v in right if kk == k and x <= t), default=(0, None))[1]) for k, t, i in left}
    assert {tuple(r) for r in got.collect()} == want
    none = as_of(spark.createDataFrame([], "k int, at long, i int"), spark.createDataFrame([], "k int, at long, v long"), ["k"], "at", ["v"])
    assert none.count() == 0


def log_lines(rng, n):
    kinds = [lambda: f'Started {rng.choice(["GET", "POST"])} "/x" for ::1', lambda: f"Processing by {rng.choice('AB')}#show as HTML", lambda: "  User Load (1.5ms)  SELECT 1", lambda: "  TRANSACTION (0.1ms)  BEGIN",
             lambda: f"Completed {rng.choice([200, 302, 500])} OK in {rng.randint(1, 9)}ms", lambda: "plain words", lambda: ""]
    return [rng.choice(kinds)() for _ in range(n)]


def plain_requests(lines):
    """Endpoint, status class, queries and duration of each request, by a state machine."""
    out, open_, method, action, queries = [], False, None, None, 0
    for line in lines:
        if m := re.match("Started ([A-Z]+) ", line):
            open_, method, action, queries = True, m[1], None, 0
        elif (m := re.match(r"Processing by (\S+)", line)) and open_:
            action = m[1]
        elif line.startswith("  User Load"):
            queries += 1
        elif m := re.match(r"Completed (\d)\d\d .* in (\d+)ms", line):
            if open_ and action:
                out.append((f"{method} {action} {m[1]}xx", float(queries), int(m[2]) * 1000))
            open_ = False
    return sorted(out)


def test_requests_over_slices(spark):
    rng = random.Random(7)
    lines = log_lines(rng, 600)
    df = spark.createDataFrame([("r", 3, interpret.LOG, i + 1, x, len(x) + 1) for i, x in enumerate(lines)], "run_id string, feed int, stream string, seq long, line string, raw_len long").repartition(4)
    got = interpret.rails(df, width=17).where("kind = 'http.request'")
    assert sorted((r["template"], r["measures"]["queries"], r["duration_us"]) for r in got.collect()) == plain_requests(lines)
    at = {r["seq"]: r["at"] for r in interpret.offsets(df, width=17).collect()}
    assert at == {i + 1: sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))}


def test_key_blocks_and_numbers_of_one_run(spark):
    rng = random.Random(8)
    texts = []
    for i in range(400):
        texts.append(rng.choice([f"mail u{rng.randrange(60)}@example.org and u{rng.randrange(60)}@example.org", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", f"line {i}", f"line {i}"]))
    df = spark.createDataFrame([("r", 0, "stdout", i, x) for i, x in enumerate(texts)], "run_id string, feed int, stream string, seq long, line string").repartition(4)
    opened, inside = 0, []
    for x in texts:
        begins, ends = "BEGIN" in x, "END" in x
        inside.append(begins or ends or opened > 0)
        opened += begins - ends
    assert [r["in_key"] for r in in_key_block(df, ["run_id", "stream"], width=13).orderBy("seq").collect()] == inside
    numbers: dict = {}
    for x, key in zip(texts, inside, strict=True):
        for value in [] if key else re.findall(EMAIL, x):
            numbers.setdefault(value, len(numbers) + 1)
    want = [x if key else re.sub(EMAIL, lambda m: f"<EMAIL_{numbers[m[0]]}>", x) for x, key in zip(texts, inside, strict=True)]
    got = [r["evidence"] for r in redact(df, "pii", width=13).orderBy("seq").collect()]
    assert [g for g, key in zip(got, inside, strict=True) if not key] == [x for x, key in zip(want, inside, strict=True) if not key]
    secrets = {g for g, key in zip(got, inside, strict=True) if key}
    assert secrets == {f"<SECRET_{k + 1}>" for k in range(len(secrets))}
