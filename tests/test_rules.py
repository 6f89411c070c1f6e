import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbers import evidence, mad_of, median_of, rate, round_sig, round_sig_long
from tidemark.operators import rules

A = lambda *v: F.array(*map(F.lit, map(float, v))) if v else F.array().cast("array<double>")
QUIET, TENS = (100, 105, 110), (1.0,) * 10
WIDE = (130, 200, 240, 245, 245, 245, 250, 300, 400, 1000)
TIGHT = (240, 242, 244, 245, 245, 245, 246, 247, 248, 250)
ALONE, THREE, TWO = (303, 4, 3, 2, 1), (303, 160, 155, 152, 1), (303, 160, 155, 4, 1)
LATENCY = [
    ((1, 1.1, 0.9), 304, {}, 0.60), ((1, 1.1), 304, {}, 0.56), ((1,), 304, {}, None), (TENS, 304, {}, 0.69), ((1, 1.1, 0.9), 150, {}, 0.48),
    ((20, 22, 250), 240, {}, None), ((50, 55, 60), 180, {}, None), ((50, 55, 60), 260, {}, 0.44), ((1000, 1100, 900), 2500, {}, None), ((1000, 1100, 900), 4200, {}, 0.41),
    ((1, 1.1, 0.9), 304, {"neighbour": 200, "slowdowns": ALONE}, None), ((10, 11, 12), 120, {"window": (QUIET, 707, 109)}, None),
    ((10, 11, 12), 120, {"window": (QUIET, 215, 109)}, 0.42), ((10, 11, 12), 120, {"window": (QUIET, 977, 872)}, 0.42),
    ((1, 1.1, 0.9), 304, {"slowdowns": ALONE}, 0.60), ((1, 1.1, 0.9), 304, {"slowdowns": THREE}, None), ((1, 1.1, 0.9), 304, {"slowdowns": TWO}, 0.60),
    (WIDE, 1050, {}, None), (TIGHT, 1050, {}, 0.48),
]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_latency(spark):
    columns = []
    for k, (base, now, more, _) in enumerate(LATENCY):
        kw = {}
        if "neighbour" in more:
            kw["neighbour"] = F.lit(float(more["neighbour"]))
        if "slowdowns" in more:
            kw["slowdowns"] = A(*more["slowdowns"])
        if "window" in more:
            w, current, excess = more["window"]
            kw["window"] = (A(*w), F.lit(float(current)), F.lit(float(excess)))
        columns.append(rules.latency(A(*base), F.lit(float(now)), **kw)["confidence"].alias(f"c{k}"))
    assert list(spark.range(1).select(*columns).first()) == [want for *_, want in LATENCY]


@pytest.mark.parametrize(("base", "now", "want"), [((3, 3, 3), 10, (True, 0.80)), ((3,) * 5, 2, (True, 0.86)), ((3, 3), 3, None), ((3,), 10, None), ((10, 12, 11), 13, None), ((10, 12, 11), 20, (False, 0.62))])
def test_frequency(spark, base, now, want):
    got = value(spark, rules.frequency(A(*base), F.lit(float(now))))
    assert (got and (got["exact"], got["confidence"])) == want


def test_presence_and_error(spark):
    p = lambda now, k, n: rules.presence(F.lit(now), F.lit(k), F.lit(n))
    got = spark.range(1).select(p(True, 0, 5).alias("a"), p(True, 2, 5).alias("b"), p(True, 0, 1).alias("c"), p(False, 5, 5).alias("d"), p(False, 4, 5).alias("e")).first()
    assert [x and (x["kind"], x["confidence"]) for x in got] == [("new", 0.86), None, None, ("disappeared", 0.86), None]
    e = lambda f, n, known: rules.error(F.lit(1), F.lit(f), F.lit(n), F.lit(known))["confidence"]
    assert list(spark.range(1).select(e(0, 5, False).alias("a"), e(0, 1, False).alias("b"), e(1, 5, True).alias("c"), e(1, 5, False).alias("d"), e(0, 0, False).alias("e")).first()) == [0.86, 0.67, None, 0.71, None]


def test_numbers(spark):
    got = spark.range(1).select(
        round_sig(F.lit(0.04567), 2).alias("a"), round_sig(F.lit(1234.0), 2).alias("b"), round_sig_long(F.lit(1250).cast("long"), 2).alias("c"), median_of(A(3, 1)).alias("d"), median_of(A()).alias("e"),
        mad_of(A(1, 2, 9)).alias("f"), evidence(F.lit(3)).alias("g"), rate(F.lit(1), F.lit(3)).alias("h"), rate(F.lit(1), F.lit(0)).alias("i"),
    ).first()
    assert list(got) == [0.046, 1200.0, 1300, 2.0, None, 1.0, 0.8, 0.3, None]
