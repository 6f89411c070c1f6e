"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its path and host are like.

A classifier gives each document a probability of good quality from the shape of its text: an additive logistic over
binned features, fitted on labelled rows. Hosts and paths (a host with the first segment of its path) gather these
probabilities by grouped sums over all documents; a document counts once with each host and each path that shows it. A
host's rate is shrunk toward the corpus's, a path's toward its host's; how strongly follows from how much sites differ (by moments), so sparse sites stay near their prior. A
document's own share is taken out of its path's and host's sums before they judge it. In log-odds, the result is

    evidence + path posterior - corpus prior

Sites come from pages: the last number in a page's URL is the document it shows. The posterior of a document on several
paths is the mean of theirs, in log-odds; so are the rates in its row, which names the least of its hosts and paths. The
corpus's rate counts each document once. A document without a page counts with its source as host and its language as path.

Cases: null and empty texts are scored by their features, all 0; a null host or path is a site of its own; labels that
are null don't train, and those that repeat for a document count as good if any is; with no labels, or of one kind only,
every document's evidence is the prior one half; documents that repeat are scored each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, materialise, texts_of

#: The classifier is fitted on about so many labelled rows, chosen by a hash of the id.
FIT_ROWS = 20_000
BINS, KEEP = 8, 0.5
FEATURES = 9
#: Parts of a site's documents, where the sites' sums are too many to broadcast.
PARTS = 32


def shape(text: str) -> list[float]:
    """Features of a text: length, word length, signs, capitals, digits, distinct words, repeats in a row, distinct lines, the top word."""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * FEATURES
    counts, lines = Counter(words), text.split("\n")
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    digits = sum(map(len, re.findall(r"[0-9]+", text)))
    upper = sum(map(len, re.findall(r"[A-Z]{2,}", text)))
    white = n - sum(map(len, words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [math.log1p(len(words)), letters / len(words), (n - white - letters - digits) / n, upper / n, digits / n, len(counts) / len(words), again / len(words), len(set(lines)) / len(lines), max(counts.values()) / len(words)]


@dataclass
class Classifier:
    """Bin edges of each feature and the logistic's weights, one a bin."""

    edges: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(x, self.edges) @ self.weights, -12, 12)))


def _design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 1 + FEATURES * BINS))
    out[:, 0] = 1.0
    for f in range(FEATURES):
        out[np.arange(len(x)), 1 + f * BINS + np.searchsorted(edges[f], x[:, f], side="left")] = 1.0
    return out


def _shapes(docs: DataFrame, *extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shape(t) for t in texts_of(b.column(1))], dtype=np.float64).reshape(-1, FEATURES)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), values, *b.columns[2:]], names=["doc_id", "x", *extra])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    return thin.mapInArrow(run, "doc_id long, x array<double>" + "".join(f", {e} int" for e in extra))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, among: Column | None = None) -> Classifier:
    """A classifier from about so many labelled rows; the driver gets their features only. among: which labels may be used."""
    known = labels.where(F.col("quality").isNotNull() & (F.lit(True) if among is None else among)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    got = _shapes(docs.select("doc_id", "text").join(F.broadcast(known.limit(2 * rows)), "doc_id"), "quality").limit(2 * rows).toArrow()  # bounded
    x, y = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, FEATURES), np.array(got["quality"].to_pylist(), dtype=np.float64)
    if len(set(y > 0)) < 2:
        return Classifier(np.zeros((FEATURES, BINS - 1)), np.zeros(1 + FEATURES * BINS))
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    d, y, beta = _design(x, edges), (y > 0).astype(float), np.zeros(1 + FEATURES * BINS)
    penalty = np.diag([1e-6] + [1.0] * FEATURES * BINS)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -12, 12)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty, d.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(edges, beta)


def evidence(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, evidence) of each document; evidence is the classifier's probability."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shape(t) for t in texts_of(b.column(1))], dtype=np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value(x))], names=["doc_id", "evidence"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, evidence double")


def sites(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, host, path): a row for each host and path whose pages show the document, each once; at least one row an id."""
    url = F.regexp_replace(F.col("url").cast("string"), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1))
    seen = pages.select(F.regexp_extract(url, r"/(\d+)[^/]*/?$", 1).try_cast("long").alias("doc_id"), host.alias("host"), F.concat(host, F.lit("/"), F.regexp_extract(url, r"^[a-z]+://[^/]+/([^/]*)", 1)).alias("path"))
    shown = seen.where(F.col("doc_id").isNotNull()).distinct().select("doc_id", F.struct("host", "path").alias("s"))
    every = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct(F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("host"), F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("?")), F.coalesce(F.col("lang").cast("string"), F.lit("?"))).alias("path"))).alias("own"))
    chosen = F.coalesce("s", "own")
    return every.join(shown, "doc_id", "left").select("doc_id", chosen["host"].alias("host"), chosen["path"].alias("path"))


def combine(evidence: DataFrame, sites: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score and keep (score of at least keep) of each document."""
    order = Window.partitionBy("doc_id").orderBy("host", "path")
    # of a document's sites, the first of each host counts for the host, the first of all for the corpus
    placed = sites.withColumns({"first": F.row_number().over(order) == 1, "new_host": ~F.col("host").eqNullSafe(F.lag("host").over(order))})
    placed = placed.select("doc_id", "host", "path", "first", (F.col("first") | F.col("new_host")).alias("of_host"))
    # texts are scored once, and what follows reads these thin rows
    rows = evidence.join(placed, "doc_id", "left").select("doc_id", F.coalesce("host", F.lit("?")).alias("host"), F.coalesce("path", F.lit("?")).alias("path"), "evidence", F.coalesce("first", F.lit(True)).alias("first"), F.coalesce("of_host", F.lit(True)).alias("of_host"))
    rows = materialise(rows, "scored-sites")
    total = lambda flag: F.sum(F.when(F.col(flag), F.col("evidence")).otherwise(0.0))
    by_path = rows.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("evidence").alias("s_path"), F.count_if("of_host").alias("n_of"), total("of_host").alias("s_of"), F.count_if("first").alias("n_first"), total("first").alias("s_first"))
    by_path = materialise(by_path, "paths")
    by_host = by_path.groupBy("host").agg(F.sum("n_of").alias("n_host"), F.sum("s_of").alias("s_host"), F.sum("n_first").alias("n_first"), F.sum("s_first").alias("s_first"))
    host_strength, prior = _strength(by_host, "n_host", "s_host")
    path_strength, _ = _strength(by_path, "n_path", "s_path")
    sums = materialise(_beside(by_path.select("host", "path", "n_path", "s_path"), by_host.select("host", "n_host", "s_host"), ["host"]), "site-sums")
    discard(by_path)
    full = _beside(rows, sums, ["host", "path"])
    own, n = F.col("evidence"), lambda c: F.col(c).cast("double")
    full = full.withColumn("host_rate", (F.col("s_host") - own + host_strength * prior) / (n("n_host") - 1 + host_strength))
    full = full.withColumn("path_rate", (F.col("s_path") - own + path_strength * F.col("host_rate")) / (n("n_path") - 1 + path_strength))
    odds = lambda p: F.log(_inside(p) / (1 - _inside(p)))
    # documents of one id and equal evidence have the same sites, so their rows are made once and repeated
    mean = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(1 / (1 + F.exp(-F.avg(odds(F.col(c))))))
    one = full.groupBy("doc_id", "evidence").agg(F.min(F.struct("host", "path")).alias("s"), mean("host_rate").alias("host_rate"), mean("path_rate").alias("path_rate"), F.count_if("first").alias("rows"))
    one = one.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    one = one.withColumn("score", 1 / (1 + F.exp(-(odds(own) + odds(F.col("path_rate")) - odds(F.lit(prior))))))
    return one.select("doc_id", "s.host", "s.path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= keep).alias("keep"))


def _beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with few, which has each key once. A key may hold any share of rows: few goes to all tasks where it is
    counted small, else rows of a key are dealt over some parts, to each of which few goes."""
    bytes_ = few.agg(F.sum(sum((F.octet_length(k) for k in keys), F.lit(64)))).first()[0] or 0
    if bytes_ <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), keys)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)))
    each = few.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(each, [*keys, "_part"]).drop("_part")


def _inside(p):
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def _strength(groups: DataFrame, n: str, s: str) -> tuple[float, float]:
    """(documents that a prior weighs, the corpus's rate), by moments of the groups' rates; from sums only."""
    n, s = F.col(n).cast("double"), F.col(s)
    row = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(s * s / n).alias("q"), F.sum(n * n).alias("n2"), F.count("*").alias("k"), F.sum("n_first").alias("n_first"), F.sum("s_first").alias("s_first")).collect()[0]
    if not row["n"]:
        return 1.0, 0.5
    mean = min(max(row["s"] / row["n"], 1e-6), 1 - 1e-6)
    within = mean * (1 - mean)
    spread = (row["q"] - row["n"] * mean * mean - (row["k"] - 1) * within) / max(1e-9, row["n"] - row["n2"] / row["n"])
    return (min(max(within / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0), min(max(row["s_first"] / row["n_first"], 1e-6), 1 - 1e-6)
