"""A streaming sink of JSON lines, each row exactly once, and a final document.

Tasks write files that nobody knows yet; a batch is committed by one rename that names its files. A batch that is done
again after a failure finds its commit, keeps it and drops what it wrote anew. Batches without rows leave nothing.
Readers take the files that commits name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..sources import files

NAME = "tidemark_ndjson"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class NdjsonSink(DataSource):
    """format(NAME) with option path; columns are strings, numbers or booleans."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return NdjsonWriter(self.options["path"].rstrip("/"))


class NdjsonWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        lines = [json.dumps(r.asDict(recursive=True), ensure_ascii=False) for r in rows]
        if not lines:
            return Written(None, 0)
        name = f"{uuid.uuid4().hex}.json"
        files.write(f"{self.path}/rows/{name}", ("\n".join(lines) + "\n").encode())
        return Written(name, len(lines))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        made = [m for m in messages if m is not None and m.file]
        at = f"{self.path}/commits/{batchId:012d}.json"
        if made and files.exists(at):
            return self.abort(messages, batchId)
        if made:
            files.publish(at, {"batch": batchId, "rows": sum(m.rows for m in made), "files": sorted(m.file for m in made)})

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        for m in messages:
            if m is not None and m.file:
                files.delete(f"{self.path}/rows/{m.file}")


def committed(path: str) -> list[str]:
    """Files of all commits, in order of their batches."""
    path = path.rstrip("/")
    found = [json.loads(files.read(f"{path}/commits/{n}")) for n in files.names(f"{path}/commits") if n.endswith(".json") and not n.startswith(".")]
    return [f"{path}/rows/{name}" for c in found for name in c["files"]]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all commits."""
    named = committed(path)
    return spark.read.schema(schema).json(named) if named else spark.createDataFrame([], schema)


def finish(path: str, document: dict) -> dict:
    """Ends a stream's output with one document, by which readers know that no more rows come; said again, the first one stays."""
    at = f"{path.rstrip('/')}/document.json"
    if not files.exists(at):
        files.publish(at, document | {"commits": len(files.names(f"{path.rstrip('/')}/commits")), "complete": True})
    return json.loads(files.read(at))
