"""WARC archives compressed with a Zstandard dictionary, written by tasks and read back.

A file is one skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame, then a frame for
each record, compressed with that dictionary, so any record can be read alone by its offset. Records are WARC/1.1: a
response carries its payload; a revisit (identical-payload-digest) carries none and names the record it refers to.

Of records with equal payloads of at least min_bytes, the one with the largest id is the response.

Cases: null html is an empty payload; a null url gives no WARC-Target-URI; rows that repeat a page_id are each
written and judged by their own payloads, and those with an equal large payload too are responses all (none refers to
itself); where a page_id repeats with different payloads, a revisit's digest tells which of its records is meant; an
empty table gives no file and no rows; other columns are ignored; a null page_id stays null and is a response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, open_fs, texts_of, write_file

DICT_FRAME = 0x184D2A5D
#: The dictionary is trained from about so many records (twice as many at most), of each so many bytes, and is as large at most as said.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 2_000, 4_096, 64 << 10
#: A file is closed once its records take so many bytes before compression.
FILE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary from archived records; a plain one of their bytes where there are too few to train from."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"WARC/1.1\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICT_FRAME, len(body)) + body


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; refers_to makes it a revisit."""
    sha1 = hashlib.sha1(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%" + c.encode("utf-8", "surrogatepass").hex("%").upper() for c in url))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1.digest()).decode()}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    out = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(out["Content-Length"])]
    out["payload"] = block.partition(b"\r\n\r\n")[2]
    return out


def decisions(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, n, refers_to): thin rows only; a payload of any number of records is summed before it is shuffled."""
    thin = pages.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= min_bytes)
    last = thin.groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("k")).where("k > 1")
    return thin.join(last, ["digest", "n"]).where("page_id < last").select("page_id", "digest", "n", F.col("last").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html) to .warc.zst files under folder; returns the manifest (path, n_records), written."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # the sample: rows of low hashes, about a bounded number of bounded prefixes however many pages there are
    share = min(1.0, SAMPLE_RECORDS / max(1, rows.count()))
    low = rows.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = low.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).limit(2 * SAMPLE_RECORDS).collect()
    dictionary = train_dictionary([record(r["page_id"], r["url"], bytes(r["payload"]), None) for r in sample])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        held, n, size = [], 0, 0

        def close():
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            write_file(path, [dictionary_frame(dictionary), *held])
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

        for b in batches:
            ids, urls, payloads, refers = (b.column(k) for k in range(4))
            for i, u, p, r in zip(ids.to_pylist(), urls.to_pylist(), payloads, refers.to_pylist(), strict=True):
                raw = record(i, u, p.as_py(), r)
                held.append(squeeze.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    yield close()
                    held, n, size = [], 0, 0
        if held:
            yield close()

    keyed = rows.withColumns({"digest": F.sha1("payload"), "n": F.length("payload")})
    decided = keyed.join(decisions(rows, min_bytes), ["page_id", "digest", "n"], "left").select("page_id", "url", "payload", "refers_to")
    return materialise(decided.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_records(path: str) -> Iterator[bytes]:
    """The records of a .warc.zst file, one after another."""
    fs, name = open_fs(path)
    with fs.open_input_stream(name, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICT_FRAME:
            raise ValueError(f"{path}: no dictionary frame")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(f.read(size)))
        expand = zstandard.ZstdDecompressor(dict_data=dictionary)
        frame, parts = expand.decompressobj(), []
        while chunk := f.read(1 << 20):
            while chunk:  # a frame takes what is its own and leaves the rest
                parts.append(frame.decompress(chunk))
                if not frame.eof:
                    break
                yield b"".join(parts)
                chunk, frame, parts = frame.unused_data, expand.decompressobj(), []
        if parts:
            raise ValueError(f"{path}: ends within a record")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(x) if (x := urn.rpartition(":")[2].rstrip(">")) else None
        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path in texts_of(b.column(0)):
                rows, size = [], 0
                for data in read_records(path):
                    x = parse(data)
                    digest, response = base64.b32decode(x["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), x["WARC-Type"] == "response"
                    if response and (hashlib.sha1(x["payload"]).hexdigest() != digest or len(x["payload"]) != int(x["X-Payload-Length"])):
                        raise ValueError(f"{path}: {x['WARC-Record-ID']} has another payload than its digest says")
                    rows.append((number(x["WARC-Record-ID"]), x.get("WARC-Target-URI"), x["payload"] if response else None, int(x["X-Payload-Length"]), digest, x["WARC-Type"], None if response else number(x["WARC-Refers-To"])))
                    size += len(data)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    paths = manifest.select("path")
    spread = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(read, schema)


def archive(pages: DataFrame, min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes pages to archives and reads them back."""
    return read_archives(write_archives(pages, folder or new_path(pages.sparkSession, "warc"), min_bytes))
