"""Lines of files and directories with exact places: seq from 1 in each stream, and raw_len, the bytes with line end.

A line ends at \\n; one \\r before it is dropped; a last line without an end counts. Lines are cut at MAX_LINE bytes, never
split, so seq stays the number of the line in its file.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files
from .scratch import shared_dir

MAX_LINE = 1 << 20
#: Bytes of a range, and of what a task reads at once.
SPLIT, BLOCK = 64 << 20, 1 << 20
CODECS = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
#: A scenario's files and their streams, in the order in which they are fed: events before the log they point into.
SCENARIO = {"stdout.txt": "stdout", "stderr.txt": "stderr", "rspec.ndjson": "file:rspec-events", "test.log": "file:log/test.log"}


def split_text(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """keys, seq, line, raw_len of each line of a text column."""
    parts = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col(text).endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).when(F.col(text) == "", F.array().cast("array<string>")).otherwise(parts)
    # the parts first, then a row each: in one step the text would be split again for every line
    whole = texts.select(*keys, kept.alias("_parts"), F.col(text).endswith("\n").alias("_ended")).withColumn("_n", F.size("_parts"))
    rows = whole.select(*keys, "_n", "_ended", F.posexplode("_parts").alias("_pos", "_raw"))
    raw_len = F.octet_length("_raw") + F.when((F.col("_pos") + 1 < F.col("_n")) | F.col("_ended"), 1).otherwise(0)
    line = F.regexp_replace("_raw", r"\r\z", "")
    return rows.select(*keys, (F.col("_pos") + 1).cast("long").alias("seq"), cut(line).alias("line"), raw_len.cast("long").alias("raw_len"))


def cut(line: Column) -> Column:
    """At most MAX_LINE bytes, whole characters only."""
    first = F.make_valid_utf8(F.substring(line.cast("binary"), 1, MAX_LINE).cast("string"))
    return F.when(F.octet_length(line) <= MAX_LINE, line).otherwise(F.regexp_replace(first, "\ufffd+$", ""))


def read_file(spark: SparkSession, path: str, stream: str = "stdout", split: int = SPLIT, **keys: str) -> DataFrame:
    """The lines of a file, or of each file of a folder. A file of more than split bytes is read by many tasks, with the
    same numbers; others, and compressed ones, are read whole."""
    large, small = [], []
    for name, size in _sizes(spark, path):
        (large if size > split and not name.endswith(CODECS) else small).append(name)
    named = [F.lit(v).alias(k) for k, v in {**keys, "stream": stream}.items()]
    out = None
    if small or not large:
        whole = spark.read.text(small or path, wholetext=True).select(*named, "value")
        out = split_text(whole, "value", [*keys, "stream"])
    if large:
        rows = ranges(spark, large, split).select(*named, "seq", "line", "raw_len")
        out = rows if out is None else out.unionByName(rows)
    return out


def _sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and bytes of a file, or of the files of a folder that readers show."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return [(f.getPath().toString(), f.getLen()) for f in fs.listStatus(at) if f.isFile() and (f.getPath().equals(at) or f.getPath().getName()[:1] not in "._")]


def ranges(spark: SparkSession, paths: Sequence[str], split: int = SPLIT) -> DataFrame:
    """path, seq, line, raw_len of the lines of files that Arrow can open, by ranges of split bytes.

    A line belongs to the range that its first byte is in. A first pass counts the lines of each range; a range's number
    goes out with it in the second, so nothing is shuffled and no file is read whole.
    """
    spark.dataSource.register(LineSource)
    given = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}.json"
    files.publish(given, {"paths": list(paths)})
    reader = spark.read.format(LineSource.name()).option("given", given).option("split", split)
    counted: dict[str, list[int]] = {}
    for r in reader.option("count", "true").load().orderBy("path", "part").collect():  # a row a range, as Spark has a task for each
        counted.setdefault(r["path"], []).append(r["n"])
    numbered = f"{given}.counted"
    files.publish(numbered, {"paths": list(paths), "before": {p: [0, *itertools.accumulate(n)] for p, n in counted.items()}})
    return spark.read.format(LineSource.name()).option("given", numbered).option("split", split).load()


@dataclass
class Range(InputPartition):
    path: str
    part: int
    start: int
    end: int
    before: int


class LineSource(DataSource):
    """format("tidemark_lines"): ranges of files, numbered or counted; see ranges()."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_lines"

    def schema(self) -> str:
        return "path string, part int, n long" if "count" in self.options else "path string, seq long, line string, raw_len long"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options["given"], int(self.options["split"]), "count" in self.options)


class LineReader(DataSourceReader):
    def __init__(self, given: str, split: int, count: bool):
        self.given, self.split, self.count = given, split, count

    def partitions(self) -> list[Range]:
        given = json.loads(files.read(self.given))
        out = []
        for path in given["paths"]:
            fs, name = files.open_fs(path)
            size = fs.get_file_info(name).size
            before = given.get("before", {}).get(path)
            out += [Range(path, k, a, min(size, a + self.split), before[k] if before else 0) for k, a in enumerate(range(0, size, self.split))]
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == part.start:
            return
        fs, name = files.open_fs(part.path)
        with fs.open_input_file(name) as f:
            if self.count:
                yield pa.RecordBatch.from_pydict({"path": [part.path], "part": pa.array([part.part], pa.int32()), "n": [_starts(f, part)]})
            else:
                yield from _numbered(f, part)


def _starts(f, part: Range) -> int:
    """Lines whose first byte is in the range."""
    n, at = int(part.start == 0), max(0, part.start - 1)
    f.seek(at)
    while at < part.end - 1:
        block = f.read(min(BLOCK, part.end - 1 - at))
        n += block.count(b"\n")
        at += len(block)
    return n


def _numbered(f, part: Range) -> Iterator[pa.RecordBatch]:
    seq, at = part.before, part.start
    kept, size, skipping = b"", 0, False  # a line's first MAX_LINE bytes, and its length so far
    if at:
        f.seek(at - 1)
        skipping = f.read(1) != b"\n"
    f.seek(at)
    lines: list[bytes] = []
    sizes: list[int] = []

    def batch() -> pa.RecordBatch:
        nonlocal seq
        seq += len(lines)
        texts = [_text(x) for x in lines]
        return pa.RecordBatch.from_pydict({"path": [part.path] * len(lines), "seq": list(range(seq - len(lines) + 1, seq + 1)), "line": texts, "raw_len": pa.array(sizes, pa.int64())})

    while size or at < part.end:
        block = f.read(BLOCK)
        pieces = block.split(b"\n")
        for k, piece in enumerate(pieces):
            ended = k + 1 < len(pieces)
            if not skipping and (size or at < part.end):  # goes on, or begins in this range
                kept, size = kept + piece[: MAX_LINE + 1 - len(kept)], size + len(piece)
                if ended or (not block and size):
                    lines.append(kept)
                    sizes.append(size + ended)
                    kept, size = b"", 0
            at += len(piece) + ended
            if ended:
                skipping = False
                if at >= part.end:
                    break
        if not block:
            break
        if sum(sizes) >= BLOCK:
            yield batch()
            lines, sizes = [], []
    if lines:
        yield batch()


def _text(raw: bytes) -> str:
    raw = raw.removesuffix(b"\r")
    text = raw[:MAX_LINE].decode("utf-8", "replace")
    return text.rstrip("\ufffd") if len(raw) > MAX_LINE else text  # whole characters only


def read_scenario(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """run_id, feed, stream, seq, line, raw_len of the files that a captured folder has; none at all is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found = None
    for feed, (name, stream) in enumerate(SCENARIO.items()):
        path = hadoop(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = read_file(spark, f"{folder}/{name}", stream, run_id=run_id).withColumn("feed", F.lit(feed))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise FileNotFoundError(f"{folder} holds none of {', '.join(SCENARIO)}")
    return found


def exit_code(spark: SparkSession, folder: str) -> int | None:
    try:
        return int(spark.read.text(f"{folder}/exit_code.txt").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
