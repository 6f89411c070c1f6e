"""Table functions for SQL: the lines of texts, with their numbers and bytes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources.lines import _text


class SplitLines:
    """split_lines(text), or split_lines(TABLE(t) PARTITION BY key ORDER BY ...): seq, line, raw_len.

    Given a table, its last column is the text, the others come along as they are, and the texts of a partition are one
    stream: a line that one ends without a line end goes on in the next. A null text is empty.
    """

    @staticmethod
    def analyze(texts: AnalyzeArgument) -> AnalyzeResult:
        own = texts.dataType.fields[:-1] if texts.isTable else []
        lines = [StructField("seq", LongType()), StructField("line", StringType()), StructField("raw_len", LongType())]
        return AnalyzeResult(StructType([*own, *lines]))

    def __init__(self):
        self.seq, self.left, self.keys = 0, b"", ()

    def eval(self, texts) -> Iterator[tuple]:
        whole = not isinstance(texts, Row)
        if whole:
            self.seq, text = 0, texts
        else:
            *self.keys, text = texts
        *ended, self.left = (self.left + (text or "").encode("utf-8", "surrogatepass")).split(b"\n")
        for raw in ended:
            yield self._row(raw, 1)
        if whole and self.left:
            yield self._row(self.left, 0)
            self.left = b""

    def terminate(self) -> Iterator[tuple]:
        if self.left:
            yield self._row(self.left, 0)

    def _row(self, raw: bytes, end: int) -> tuple:
        self.seq += 1
        return (*self.keys, self.seq, _text(raw), len(raw) + end)


def register(spark: SparkSession) -> None:
    """Makes split_lines known to SQL."""
    spark.udtf.register("split_lines", F.udtf(SplitLines))
