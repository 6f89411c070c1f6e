"""Offsets that a test runner noted in a log file, moved to places in the part of the log that a run kept.

A run keeps one part of its log, or two where the file was rotated meanwhile. A part is a row of segments: run_id, place
(its order), ino, from and to (bytes of the file with that inode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how a runner's event ends that names a place in the log.
OFFSET = r'(?s)^(.*),"log_offset":(\d+),"log_ino":(\d+)\}$'
HEADER = "# Logfile created on "


def placed(segments: DataFrame) -> DataFrame:
    """run_id and its segments in order, each with base, the bytes of those before it. A run has few segments."""
    before = Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("base", F.coalesce(F.sum(F.col("to") - F.col("from")).over(before), F.lit(0)))
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "ino", "from", "to", "base"))).alias("segments"))


def rebase(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """lines (run_id, line, ...) whose ending names an offset within the kept log, or none where that can't be placed.

    Lines without such an ending stay as they are. An offset lies in the first segment of its inode that holds it, both
    ends included.
    """
    rows = lines.join(placed(segments), "run_id", "left")
    offset, ino = (F.regexp_extract("line", OFFSET, k).try_cast("long") for k in (2, 3))
    hit = F.try_element_at(F.filter("segments", lambda s: (s["ino"] == ino) & offset.between(s["from"], s["to"])), F.lit(1))
    known = F.concat(F.lit(',"log_offset":'), (hit["base"] + offset - hit["from"]).cast("string"))
    moved = F.concat(F.regexp_extract("line", OFFSET, 1), F.coalesce(known, F.lit("")), F.lit("}"))
    return rows.withColumn("line", F.when(offset.isNotNull() & ino.isNotNull(), moved).otherwise(F.col("line"))).drop("segments")


def without_header(lines: DataFrame) -> DataFrame:
    """Lines without the one that a logger writes at the top of a new file."""
    return lines.where(~((F.col("seq") == 1) & F.col("line").startswith(HEADER)))
