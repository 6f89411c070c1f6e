"""Secret scans: fixed patterns, and random strings by their token efficiency.

The base has three kinds, matched from the left without overlap: assign (a value given to a name like password), access
(AKIA keys) and hex (long runs of hexadecimal digits). The method adds kind token: strings of at least LEAST characters
that a tiktoken vocabulary needs many tokens for, at most RATIO characters a token, since its merges were learned from
words. Left out are strings of digits or of letters of one case (or with a first capital), what signs join of such
parts, hexadecimal digests of known lengths, UUIDs, and whatever overlaps a base span. Letters of mixed cases are tested.

Whole texts are looked through for long runs of such characters and for the names first, with numpy and plain search;
only texts that hold one go on to the patterns. Places are code points, ends exclusive.

Cases: null and empty texts hold nothing; documents that repeat are reported each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts_of

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)  # noqa: E731  of ASCII letters only
ASSIGN = re.compile("(" + "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
KINDS = ("assign", "access", "hex", "token")
LEAST, RATIO = 20, 2.2
_RUN = np.zeros(256, dtype=bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]  # a run is matched whole, so this is the same


def _wordlike(part: str) -> bool:
    """Letters of one case, or a capital before small ones; letters of mixed cases may be a key."""
    return part.isalpha() and (part[1:].islower() or part.islower() or part.isupper())


class TokenTest:
    """Whether a string looks random to a vocabulary: few characters a token."""

    def __init__(self, vocabulary: str, pattern: str, ratio: float):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding, self.ratio = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ratio

    def __call__(self, s: str) -> bool:
        if len(s) < LEAST or not any(c.isalpha() for c in s) or DIGEST.fullmatch(s) or UUID.fullmatch(s):
            return False
        if all(p.isdigit() or _wordlike(p) for p in re.split(r"[+/_=-]+", s) if p):
            return False
        return len(s) <= self.ratio * len(self.encoding.encode_ordinary(s))


def token_spans(text: str, test: TokenTest, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out, begins, ends = [], [], []
    for _, x, y in sorted(taken, key=lambda t: t[1]):  # merged: apart, in order
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            begins.append(x)
            ends.append(y)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while a < b and text[a] in "=-_/+":
            a += 1
        while b > a and text[b - 1] in "-_/+":
            b -= 1
        k = bisect_left(begins, b)  # those from k on begin after it; the one before reaches furthest
        if not (k and ends[k - 1] > a) and test(text[a:b]):
            out.append(("token", a, b))
    return out


def long_runs(texts: list[str], least: int = LEAST) -> np.ndarray:
    """Which texts hold a run of at least so many candidate characters."""
    out = np.zeros(len(texts), dtype=bool)
    for first, block in blocks(texts):
        joined = np.frombuffer(b" ".join(block) + b" ", dtype=np.uint8)
        other = np.flatnonzero(~_RUN[joined])
        if len(other):
            ends = other[np.diff(other, prepend=-1) > least]
            starts = np.cumsum([0, *(len(t) + 1 for t in block)])
            out[first + np.unique(np.searchsorted(starts, ends, side="right") - 1)] = True
    return out


def scan(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """(doc_id, spans) of each document: spans are (kind, start, end) by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TokenTest(vocabulary, pattern, ratio)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts, out = texts_of(b.column(1)), []
            for text, run in zip(texts, long_runs(texts), strict=True):
                lower = text.lower()  # of ASCII names; other letters only add texts to look at
                if not run and not any(n in lower for n in NAMES):
                    out.append([])
                    continue
                found = base_spans(text)
                found += token_spans(text, test, found) if run else []
                out.append([{"kind": k, "start": a, "end": z} for k, a, z in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, a digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
