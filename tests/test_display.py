from pyspark.sql import functions as F

from tidemark.functions import display
from tidemark.operators import slots


def column(spark, rows, kind, expression):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_numbers_as_text(spark):
    assert column(spark, [0, 999, 1000, 12_345, 999_400, 1_000_000, 61_250_000, 12_345_678_000_000, None], "long", display.duration_text) == ["0µs", "999µs", "1ms", "12.3ms", "999ms", "1s", "61.3s", "12300000s", None]
    assert column(spark, [-5, 0, 59, 60, 3599, 3600, 86_399, 86_400, 200_000, None], "long", display.age_text) == ["0s ago", "0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "2d ago", None]
    sizes = [0, 1023, 1024, 1536, 10 * 1024**2 + 5, 3 * 1024**3, 5 * 1024**4, 5000 * 1024**4, None]
    assert column(spark, sizes, "long", display.bytes_text) == ["0 B", "1023 B", "1 KB", "1.5 KB", "10 MB", "3 GB", "5 TB", "5000 TB", None]
    assert column(spark, [0, 1, 2], "long", lambda c: display.plural(c, "change")) == ["0 changes", "1 change", "2 changes"]


def test_words_of_a_shell(spark):
    argv = [["run", "a b", "it's", "", "x=1,/y", "$HOME", "new\nline", "é"], [], ["\\"]]
    lines = column(spark, argv, "array<string>", display.shell_join)
    assert lines == ["run 'a b' 'it'\\''s' '' x=1,/y '$HOME' 'new\nline' 'é'", "", "'\\'"]
    assert column(spark, lines, "string", display.shell_split) == argv
    assert column(spark, ["a 'b", 'a "b"', "$x", "a\\", "a\\ b  c", "a'b c'd", None], "string", display.shell_split) == [None, None, None, None, ["a b", "c"], ["ab cd"], None]


def test_printable(spark):
    rows = ["\x1b[31mred\x1b[0m", "a\tb\u0085c", "abcdef", "abcde", "\x1bx", "", None]
    assert column(spark, rows, "string", lambda c: display.printable(c, 5)) == ["red", "abc", "abcde…", "abcde", "x", "", None]


def test_samples_are_the_commonest_values(spark):
    rows = [("a", v) for v in "zzzyyxxwvut"] + [(None, "q"), (None, None), ("b", None)]
    df = spark.createDataFrame(rows, "slot string, value string").withColumn("kind", F.lit("quoted"))
    got = {r["slot"]: (r["total"], r["samples"]) for r in slots.statistics(df, ["slot"]).collect()}
    assert got == {"a": (11, ["z", "x", "y", "t", "u"]), None: (2, [None, "q"]), "b": (1, [None])}
    assert slots.statistics(df.limit(0), ["slot"]).count() == 0
