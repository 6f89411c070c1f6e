"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding homoglyphs and digit substitutions.

Folding maps letters of other scripts that look like Latin ones, full-width forms, accents, digits and signs put for
letters to plain letters (i, l and 1 become one), so spellings made to evade the lexicon match it. Entries are words,
or stems (the first letters of a word). A hit inside an exception phrase doesn't count; of hits that start at one place
the heaviest does. The summed weight and its density (by the square root of the length in words) go into a logistic.

Weights are fitted from labelled rows: an entry's weight is its log-odds among toxic against other rows. It is kept only
where the evidence beats the number of entries tested (log-likelihood ratio, Bonferroni). Toxic rows count once for
each signature, so copies are no evidence of their own. At most about FIT_ROWS rows are used, chosen by a hash of the id.

Cases: null and empty texts score as texts without a hit; rows without a label or a null one don't train; with no
training rows, or of one class only, the seed lexicon with its default weight decides; labels that repeat for a document
count as toxic if any is; documents that repeat are scored each; a null doc_id is not held out; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

FIT_ROWS = 30_000
STEM = 5
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and digits and signs put for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "s", "æ": "a", "œ": "o", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}

# Insults that count before any label is seen, and phrases in which they are harmless.
SEED = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumbass", "bastard", "asshole", "bitch"]
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "clown nose", "sore loser clause", "pond scum"]
SEED_WEIGHT = 4.0


def _table() -> dict[int, str]:
    table = {c: unicodedata.normalize("NFKD", chr(c))[0].lower() for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]}
    table |= {ord(k): v for k, v in LOOKALIKES.items()} | {ord(k.upper()): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1 and ord(k.upper()) > 127}
    table |= {c: chr(c + 32) for c in range(65, 91)} | {ord(k): v for k, v in DIGITS.items()}
    table |= dict.fromkeys([*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0xFEFF], "")  # marks and characters of no width
    table = {k: DIGITS.get(v, v) for k, v in table.items()}
    return {k: "l" if v == "i" else v for k, v in table.items()} | {ord("i"): "l", ord("I"): "l"}


TABLE = _table()
INNER = re.compile(r"(?<=[a-z])[@$!|](?=[a-z])")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    t = text.translate(TABLE)
    if any(s in t for s in SIGNS):
        t = INNER.sub(lambda m: SIGNS[m[0]].replace("i", "l"), t)
    return t


@dataclass
class Lexicon:
    """Words, stems with a * at the end, and their weights, all folded; the logistic's bias and factors."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: [fold(x) for x in EXCEPTIONS])
    logistic: tuple[float, float, float] = (-4.0, 3.0, 1.0)

    def automaton(self):
        import ahocorasick

        a, entries = ahocorasick.Automaton(), {}
        for e, w in self.weights.items():
            entries.setdefault(e.rstrip("*"), {})["stem" if e.endswith("*") else "word"] = w
        for x in self.exceptions:
            entries.setdefault(x, {})["except"] = 0.0
        for text, kinds in entries.items():
            a.add_word(text, (len(text), kinds))
        if entries:
            a.make_automaton()
        return a if entries else None


def features(text: str, automaton) -> tuple[float, float, int]:
    """(log of 1 + the weight, weight over the root of the length, hits)."""
    t, starts, harmless = fold(text), {}, []
    for last, (size, kinds) in automaton.iter(t) if automaton else ():
        a, b = last + 1 - size, last + 1
        if a and t[a - 1].isalnum():
            continue
        whole = b == len(t) or not t[b].isalnum()
        if whole and "except" in kinds:
            harmless.append((a, b))
        found = max(kinds.get("word", 0.0) if whole else 0.0, kinds.get("stem", 0.0))
        if found > starts.get(a, (0.0, 0))[0]:
            starts[a] = (found, b)
    # how far the exceptions that begin up to a place reach
    harmless.sort()
    begins, reach = [x for x, _ in harmless], list(accumulate((y for _, y in harmless), max))
    hits = [w for a, (w, b) in starts.items() if not ((k := bisect_right(begins, a)) and reach[k - 1] >= b)]
    total = sum(hits)
    return math.log1p(total), total / math.sqrt(t.count(" ") + t.count("\n") + 1), len(hits)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _entries(text: str) -> tuple[set[str], int]:
    """(words and stems, a signature that near copies mostly share)."""
    words = set(WORD.findall(fold(text)))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}, min((hash_of(w) for w in words if len(w) > 3), default=0)


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from the labelled rows that are not held out."""
    seed = Lexicon({fold(w): SEED_WEIGHT for w in SEED})
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    total = known.count()
    if not total:
        return seed
    share = min(1.0, rows / total)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.limit(2 * rows)), "doc_id").select("text", "toxic")  # bounded

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("entry", pa.string()), ("signature", pa.int64()), ("n", pa.int64())])
        for b in (part for batch in batches for part in slices(batch, 0, limit=8 << 20)):
            clean, toxic, kinds = Counter(), [], Counter()
            for text, label in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                found, signature = _entries(text)
                if label:
                    toxic += [(e, signature, 1) for e in found] + [("", signature, 1)]
                else:
                    clean.update(found)
                    kinds[""] += 1
            rows = toxic + [(e, None, n) for e, n in (clean + kinds).items()]
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[k : k + 50_000], strict=True), types, strict=True)], schema=types)

    counted = train.mapInArrow(count, "entry string, signature long, n long")
    # a toxic row counts once a signature; the others are sums already
    once = counted.groupBy("entry", "signature").agg(F.sum("n").alias("n"))
    tallies = once.groupBy("entry").agg(F.count("signature").alias("toxic"), F.coalesce(F.sum(F.when(F.col("signature").isNull(), F.col("n"))), F.lit(0)).alias("clean")).where("toxic >= 3")
    tallies = tallies.cache()
    sums = tallies.where("entry = ''").collect()
    if not sums or not sums[0]["clean"]:
        tallies.unpersist()
        return seed
    t_all, c_all, tested = float(sums[0]["toxic"]), float(sums[0]["clean"]), max(2, tallies.count())
    # every entry that the evidence speaks for; the bounded rows bound them
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    odds = F.log(((t + 0.5) / (t_all + 1)) / ((c + 0.5) / (c_all + 1)))
    mean_t, mean_c = (t + c) * t_all / (t_all + c_all), (t + c) * c_all / (t_all + c_all)
    ratio = t * F.log(t / mean_t) + F.when(c > 0, c * F.log(c / mean_c)).otherwise(0.0)
    best = tallies.where("entry <> ''").select("entry", odds.alias("w"), ratio.alias("evidence")).where((F.col("w") > 2.0) & (F.col("evidence") > math.log(tested) + 3.0))
    weights = {r["entry"]: r["w"] for r in best.collect()}
    tallies.unpersist()
    lexicon = Lexicon(seed.weights | weights)
    points = scored(train.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic"), lexicon, ["toxic"]).groupBy(F.round("x1", 2).alias("x1"), F.round("x2", 2).alias("x2"), "toxic").count()
    rows_ = points.collect()  # at most as many as the bounded rows, rounded and summed
    lexicon.logistic = _newton(np.array([[1.0, r["x1"], r["x2"]] for r in rows_]), np.array([float(r["toxic"] > 0) for r in rows_]), np.array([float(r["count"]) for r in rows_]))
    return lexicon


def _newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    beta, penalty = np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ beta)
        beta += step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-6:
            break
    # more hits never make a text less toxic
    return float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2]))


def scored(docs: DataFrame, lexicon: Lexicon, extra: list[str] | None = None) -> DataFrame:
    """doc_id, score, hits and the two features of each document, and the extra columns (int)."""
    extra = extra or []
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton, (b0, b1, b2) = lexicon.automaton(), lexicon.logistic
        for b in (part for batch in batches for part in slices(batch, 1)):
            f = np.array([features(t, automaton) for t in texts_of(b.column(1))], dtype=np.float64).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(b0 + b1 * f[:, 0] + b2 * f[:, 1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(f[:, 2].astype(np.int64)), pa.array(f[:, 0]), pa.array(f[:, 1]), *b.columns[2:]], names=["doc_id", "score", "hits", "x1", "x2", *extra])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    return thin.mapInArrow(run, "doc_id long, score double, hits long, x1 double, x2 double" + "".join(f", {x} int" for x in extra))


def classify(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and hits of each document."""
    s = scored(docs, lexicon)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; they are scored where they stand."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton, (b0, b1, b2) = lexicon.automaton(), lexicon.logistic
        for b in (part for batch in batches for part in slices(batch, place)):
            f = np.array([features(t, automaton) for t in texts_of(b.column(place).cast(pa.string()))], dtype=np.float64).reshape(-1, 3)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(b0 + b1 * f[:, 0] + b2 * f[:, 1], -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
