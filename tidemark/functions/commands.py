"""Commands as text: whether one runs a test suite, scheduled jobs in tables of them, and names nearly typed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters that make a command one for a shell.
SHELL = r"""[|&;<>()$`\\"'*?\[\]#~%{}!]"""


def suite(argv: Column) -> Column:
    """rspec or other for an array of words that starts a known test run, else null."""
    base = lambda c: F.substring_index(c, "/", -1)
    bundled = base(F.get(argv, 0)) == "bundle"
    words = F.when(bundled, F.when(F.get(argv, 1) == "exec", F.slice(argv, 3, F.greatest(F.size(argv) - 2, F.lit(0))))).otherwise(argv)
    program, task = base(F.get(words, 0)), F.get(words, 1)
    by_task = F.when(task.rlike("^spec(:|$)"), "rspec").when(task.rlike("^test(:|$)"), "other")
    return F.when(program == "rspec", "rspec").when(program.isin("rake", "rails"), by_task)


def jobs(lines: DataFrame, with_user: bool = False, program: str = "tidemark") -> DataFrame:
    """lines with schedule, user, command and wrapped, of those that schedule a job; comments and settings are left out.

    A schedule has five fields, or one that begins with @. wrapped is the line that runs the job under program, through a
    shell where the command needs one.
    """
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    user = r"(\S+)\s+" if with_user else "()"
    pattern = rf"(?s)^(@\S+|\S+\s+\S+\s+\S+\s+\S+\s+\S+)\s+{user}(\S.*)$"
    setting = F.regexp_extract(text, r"^(\S+)", 1)
    rows = lines.where((text != "") & ~text.startswith("#") & ~(setting.contains("=") & ~setting.startswith("@")) & text.rlike(pattern))
    rows = rows.withColumns({"schedule": F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+", " "), "user": F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), "command": F.regexp_extract(text, pattern, 3)})
    shell = F.col("command").rlike(SHELL) | F.regexp_extract("command", r"^(\S+)", 1).contains("=")
    run = F.when(shell, F.concat(F.lit("sh -c '"), F.replace("command", F.lit("'"), F.lit("'\\''")), F.lit("'"))).otherwise(F.col("command"))
    return rows.withColumn("wrapped", F.concat_ws(" ", "schedule", "user", F.lit(f"{program} --quiet-unless-changed --"), run))


def nearest(word: Column, names: Sequence[str], most: int = 2) -> Column:
    """The name within most edits of word, closest first, then by name; null if there is none. A name of few letters needs fewer."""
    known = F.array(*[F.struct(F.levenshtein(word, F.lit(n)).alias("d"), F.lit(n).alias("name")) for n in names])
    return F.array_min(F.filter(known, lambda x: (x["d"] <= most) & (x["d"] < F.length(x["name"]))))["name"]
