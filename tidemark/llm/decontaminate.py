"""Benchmark decontamination by pigeonhole edit matching.

Texts are folded: lower case, runs of white space one space. An item of m characters may be k edits away, k =
rate * m, at most as many as leave pieces of piece_chars each. Cut into k + 1 pieces, any text within k edits of the
item holds one piece unchanged at most k places from where it stood. An Aho-Corasick automaton of all pieces finds
those hits in whole texts; around each, Myers' bit-parallel edit distance decides whether the item stands there.

Items are dealt into slices whose automaton is bounded and written to the shared folder by tasks; each task reads them
from there, so texts are read once and neither items nor documents pass through the driver.

Cases: null or blank texts hold nothing, and blank items are found nowhere; items that repeat are each reported; a
document is reported with each item once, at its least distance, then first place; in matches(), documents without a hit
give no row; in report(), each row of the documents gives one, judged by its own text, also where its doc_id is null or
repeats; an empty table on either side gives no match; other columns are ignored in both and kept by clean().
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, read_file, slices, texts_of, write_file

RATE, PIECE_CHARS = 0.05, 16
#: Characters of items in a slice: its automaton takes some hundreds of bytes a character.
SLICE_CHARS = 400_000
WHITE = re.compile(r"[ \t\n\r\f\v]+")


def fold(text: str) -> str:
    return WHITE.sub(" ", text.lower()).strip(" ")


def edits(m: int, rate: float = RATE, piece_chars: int = PIECE_CHARS) -> int:
    """How many edits an item of m characters may have."""
    return max(0, min(int(rate * m), m // piece_chars - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece): item cut into k + 1 about equal pieces."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(least distance of pattern to any substring of text, the first end of such a one); distance k + 1 if above k."""
    m = len(pattern)
    masks = peq(pattern) if masks is None else masks
    pv, mv, score, best, end, top, full = (1 << m) - 1, 0, m, k + 1, -1, 1 << (m - 1), (1 << m) - 1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        xv = eq | mv
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def peq(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class Finder:
    """All items of a slice: finds those within their error budget in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float, piece_chars: int):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if t := fold(text):
                k, n = edits(len(t), rate, piece_chars), len(self.items)
                self.items.append((item_id, t, k, peq(t)))
                for at, piece in pieces(t, k):
                    uses.setdefault(piece, []).append((n, at))
        for piece, where in uses.items():
            self.automaton.add_word(piece, (len(piece), where))
        if uses:
            self.automaton.make_automaton()

    def __call__(self, t: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of each item in a folded text, at its best; start is that of an exact-length match."""
        if not self.items:
            return []
        spots: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(t):
            for n, at in where:
                spots.setdefault(n, set()).add(last + 1 - size - at)
        out = []
        for n, starts in spots.items():
            item_id, item, k, masks = self.items[n]
            ordered = sorted(starts)  # where the item would stand without edits before the piece
            exact = next((s for s in ordered if s >= 0 and t.startswith(item, s)), None)
            if exact is not None:
                out.append((item_id, 0, exact, exact + len(item)))
            elif k:
                best = None
                for low, high in _windows(ordered, len(item), k):
                    d, end = myers(item, t[low:high], k, masks)
                    if d <= k and (best is None or d < best[1]):
                        best = (item_id, d, max(0, low + end - len(item)), low + end)
                if best:
                    out.append(best)
        return out


def _windows(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that hold all that may stand at starts with k edits; those that overlap are one."""
    low, high = max(0, starts[0] - k), starts[0] + m + k
    for s in starts[1:]:
        if s - k > high:
            yield low, high
            low = max(0, s - k)
        high = s + m + k
    yield low, high


def write_slices(items: DataFrame, chars: int) -> list[str]:
    """Writes items to files of about so many characters (or one longer item) and returns their paths, a few bytes a slice."""
    thin = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folder, schema = new_path(items.sparkSession, "item-slices"), pa.schema([("item_id", pa.int64()), ("text", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(ids, texts):
            path, sink = f"{folder}/{uuid.uuid4().hex}.arrow", pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], schema=schema))
            write_file(path, [sink.getvalue()])
            return pa.RecordBatch.from_pydict({"path": [path]})

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= chars:
                    yield close(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield close(ids, texts)

    total = thin.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = thin.repartition(max(1, -(-total // chars)), F.xxhash64("item_id", "text"))
    return sorted(r["path"] for r in dealt.mapInArrow(write, "path string").collect())


@lru_cache(1)
def finder_of(path: str, rate: float, piece_chars: int) -> Finder:
    """That of a slice, kept by a Python worker while it goes through its texts."""
    rows = pa.ipc.open_stream(read_file(path)).read_all()
    return Finder(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)), rate, piece_chars)


def _search(docs: DataFrame, items: DataFrame, rate: float, piece_chars: int, slice_chars: int, place: int, schema, make) -> DataFrame:
    """docs through make(batch, hits of each row), with all slices of the items."""
    paths = docs.sparkSession.sparkContext.broadcast(write_slices(items, slice_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with one slice small parts will do; with more, a batch goes through each slice as a whole
        limit = 4 << 20 if len(paths.value) < 2 else 1 << 30
        for b in (part for batch in batches for part in slices(batch, place, limit=limit)):
            texts = [fold(t) for t in texts_of(b.column(place).cast(pa.string()))]
            hits = [[] for _ in texts]
            for path in paths.value:
                find = finder_of(path, rate, piece_chars)
                for found, t in zip(hits, texts, strict=True):
                    found += find(t)
            yield make(b, hits)

    return docs.mapInArrow(run, schema)


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, piece_chars: int = PIECE_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, edits, start and end in the folded text."""
    types = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def make(b: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        rows = [(doc, *hit) for doc, found in zip(b.column(0).to_pylist(), hits, strict=True) for hit in found]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)

    return _search(_thin(docs), items, rate, piece_chars, slice_chars, 1, "doc_id long, item_id long, edits int, start long, end long", make)


def report(docs: DataFrame, items: DataFrame, rate: float = RATE, piece_chars: int = PIECE_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """A row for each row of docs: doc_id, contaminated, the sorted ids of the items found, and their least edits."""

    def make(b: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        ids = pa.array([sorted({x[0] for x in h if x[0] is not None}) for h in hits], pa.list_(pa.int64()))
        least = pa.array([min((x[1] for x in h), default=None) for h in hits], pa.int32())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([bool(h) for h in hits], pa.bool_()), ids, least], names=["doc_id", "contaminated", "item_ids", "least_edits"])

    return _search(_thin(docs), items, rate, piece_chars, slice_chars, 1, "doc_id long, contaminated boolean, item_ids array<long>, least_edits int", make)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, piece_chars: int = PIECE_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The documents in which no item was found, with all their columns, where they stand."""
    return _search(docs, items, rate, piece_chars, slice_chars, docs.columns.index("text"), docs.schema, lambda b, hits: b.filter(pa.array([not h for h in hits], pa.bool_())))
