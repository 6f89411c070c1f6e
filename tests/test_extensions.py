"""Interpreters of one's own, and the table function of lines."""

from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import interpret

LINES = "run_id string, feed int, stream string, seq long, line string, raw_len long"


def test_an_interpreter_takes_lines_from_the_others(spark):
    rows = [("r", 0, "stdout", 1, "PING 12 ms=7", 13), ("r", 0, "stdout", 2, "plain 3", 8), ("r", 0, "stdout", 3, "test a::b ... ok", 17), ("r", 0, "stdout", 4, "PONG", 5)]
    lines = spark.createDataFrame(rows, LINES)

    def pings(left):
        mine = left.where(F.col("line").startswith("PING"))
        return interpret.event_rows(mine, "net.ping", F.lit("ping"), F.regexp_extract("line", r"ms=(\d+)", 1).cast("long") * 1000)

    def shouts(left):  # asked second, so it gets no PING
        return interpret.event_rows(left.where(F.col("line").rlike("^[A-Z]{4}")), "shout", F.lower(F.substring("line", 1, 4)))

    interpret.register("shouts", shouts)
    try:
        got = interpret.interpret(lines, first=[pings])
        assert {(r["seq"], r["kind"], r["template"], r["duration_us"]) for r in got.collect()} == {(1, "net.ping", "ping", 7000), (2, "log", "plain <int>", None), (3, "test.example", "a::b", None), (4, "shout", "pong", None)}
    finally:
        interpret.register("shouts", None)
    assert not interpret.CLAIMS


def test_split_lines_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([("a", 1, "x\r\nhalf"), ("a", 2, " line\n\n"), ("b", 1, "é"), ("c", 1, None)], "k string, part int, text string").createOrReplaceTempView("split_me")
    got = spark.sql("SELECT k, seq, line, raw_len FROM split_lines(TABLE(SELECT k, part, text FROM split_me) PARTITION BY k ORDER BY part)")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x", 3), ("a", 2, "half line", 10), ("a", 3, "", 1), ("b", 1, "é", 2)]
    one = spark.sql("SELECT k, part, s.* FROM split_me, LATERAL split_lines(text) s WHERE k < 'c'")
    assert sorted(map(tuple, one.collect())) == [("a", 1, 1, "x", 3), ("a", 1, 2, "half", 4), ("a", 2, 1, " line", 6), ("a", 2, 2, "", 1), ("b", 1, 1, "é", 2)]
