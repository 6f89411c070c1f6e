"""Values as people read them, as Column expressions: durations, ages, sizes, counted words, commands and lines for a terminal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_sig

# Names of sizes, and the characters that a shell takes as they are.
UNITS = ("B", "KB", "MB", "GB", "TB")
ESCAPE = "\x1b\\[[^@-~]*[@-~]?|\x1b"
PLAIN = r"^[A-Za-z0-9\-_./=:@%+,]+$"


def _number(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def duration_text(us: Column) -> Column:
    """Microseconds in µs, ms or s, to three significant digits."""
    in_ms, in_s = (_number(round_sig(us.cast("double") / scale, 3)) for scale in (1e3, 1e6))
    return F.when(us < 1000, F.concat(us.cast("long").cast("string"), F.lit("µs"))).when(us < 1_000_000, F.concat(in_ms, F.lit("ms"))).otherwise(F.concat(in_s, F.lit("s")))


def age_text(seconds: Column) -> Column:
    """How long ago, in the largest whole unit; what lies ahead is 0 seconds ago."""
    s = F.greatest(seconds.cast("long"), F.when(seconds.isNotNull(), 0).cast("long"))
    ago = lambda scale, unit: F.concat(F.floor(s / scale).cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h")).otherwise(ago(86_400, "d"))


def bytes_text(n: Column) -> Column:
    """A size in powers of 1024, to three significant digits; whole bytes below 1024."""
    out = F.concat(_number(round_sig(n.cast("double") / 1024.0**4, 3)), F.lit(" TB"))
    for k in reversed(range(1, len(UNITS) - 1)):
        out = F.when(n < 1024 ** (k + 1), F.concat(_number(round_sig(n.cast("double") / 1024.0**k, 3)), F.lit(f" {UNITS[k]}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def shell_join(argv: Column) -> Column:
    """An array of words as one line for a shell; words with other than plain characters are quoted."""
    quoted = lambda w: F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.array_join(F.transform(argv, lambda w: F.when(w.rlike(PLAIN), w).otherwise(quoted(w))), " ")


def shell_split(line: Column) -> Column:
    """The words of a line that shell_join() made; null for a line with an open quote or with what it never leaves bare."""
    part = r"""'[^']*'|\\.|[^'"$`\\ ]"""
    words = F.regexp_extract_all(line, F.lit(f"(?s)((?:{part})+)"), F.lit(1))
    return F.when(line.rlike(rf"(?s)\A(?:{part}| )*\z"), F.transform(words, lambda w: F.regexp_replace(w, r"(?s)'([^']*)'|\\(.)", "$1$2")))


def printable(text: Column, most: int) -> Column:
    """Without escapes and control characters, cut after so many characters with a mark."""
    plain = F.regexp_replace(F.regexp_replace(text, ESCAPE, ""), r"\p{Cc}", "")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)
