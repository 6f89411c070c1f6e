"""Jaccard self-join of word-shingle sets with adaptive multi-match prefixes, down to connected components.

A document's set holds 64-bit hashes of its shingles of five words; one with fewer words has its whole sequence as the
only member. Sets are ordered by (class of estimated frequency, hash), the same order for all. Two sets with
100 * |x & y| >= 75 * |x | y| share at least l members within their first |x| - ceil(0.75 |x|) + l ones, for every l.

Each document picks its own l, from 1 to MATCHES: a longer prefix costs more postings, of which each candidate must
share more, so a document whose prefix holds frequent shingles lengthens it until the estimated cost stops to fall. For
a pair the smaller l holds. The steps:

1. Equal sets become one (by a 128-bit fingerprint and the size), so copies are never compared.
2. Shingles that repeat within blocks of documents, over the whole table, are counted by class; the most frequent ones,
   a bounded number, go to all tasks and give the order and the cost estimates. Any order gives the same links.
3. Hubs: each prefix shingle proposes its most central document (the one with the fewest shingles of its own, as the
   original among edited copies) to its others. A document is verified with the hub that it shares most with, if that
   is enough, and the links are joined up. That finds nearly all links of large groups without pairing their members.
4. The rest: where a shingle still has documents of different components, those pairs (never two of one component) are
   counted (documents of a shingle that many have meet in pairs of blocks, each a group of its own), held to the multi-match bound (with the overlap that their own two sizes need, which shortens the prefix
   that counts), verified, and the links added. Nothing is dropped, so components are exact.

Pairs whose sketches (counts of members by cell, an upper bound of the overlap) rule out a link are dropped first;
verification hashes both whole texts again and compares the sets. A prefix is compared as a whole, also with one of a
smaller l, which asks for no more than the bound does.

Cases: null or empty text and text of white space only has an empty set, is linked with nothing and is its own
component; equal rows link by step 1; rows that share a doc_id are one document of several texts, linked where any of
them is, and share its component; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, blocks, discard, materialise, mix, slices, texts_of
from .components import components

SPACE = [0x20, *range(0x09, 0x0E)]
WORDS = 5
MATCHES = 6
#: Frequent shingles known to all tasks, 9 bytes each.
FREQUENT = 300_000
#: Members of one block whose repeats are counted together.
BLOCK_MEMBERS = 2_500_000
#: What verifying a candidate costs, in postings.
VERIFY_COST = 20.0
#: Documents of one shingle that are compared in one group; more are cut into blocks.
BLOCK = 2_000


class Shingler:
    def __init__(self, words: int = WORDS):
        self.n, self.hasher = words, WordHasher(SPACE)
        self.factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def sets(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, sorted distinct shingle hashes) of each text."""
        n = self.n
        for first, block in blocks(texts):
            words, start, *_ = self.hasher.words(block)
            grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
            for k in range(n if len(grams) else 0):
                grams += words[k : k + len(grams)] * self.factors[k]
            grams = mix(grams)
            for d in range(len(block)):
                a, b = int(start[d]), int(start[d + 1])
                if b - a >= n:
                    s = np.sort(grams[a : b - n + 1])
                    yield first + d, s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
                elif b > a:
                    short = words[a:b] * self.factors[: b - a]
                    yield first + d, mix(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
                else:
                    yield first + d, grams[:0]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    one, two = mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def need(n: int, percent: int) -> int:
    """How many members a set of n must share with any that it links with."""
    return -(-percent * n // 100)


SCAN = "kind int, id long, n long, f1 long, f2 long"


def scan(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Kind 0: (doc_id, size, fingerprint) of each document. Kind 1: (shingle, times) of those that repeat within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, seen = Shingler(words), [], 0, set()

        def repeats():
            s = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            times = np.diff(edge)
            many = times >= 2
            return _batch(1, s[edge[:-1][many]].view(np.int64), times[many], None, None)

        for b in (part for batch in batches for part in slices(batch, 1)):
            ids = b.column(0)
            sizes, ones, twos = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for k, s in shingler.sets(texts_of(b.column(1))):
                sizes[k], (ones[k], twos[k]) = len(s), fingerprint(s)
                key = (int(ones[k]), int(twos[k]))
                if len(s) and key not in seen:  # copies within a block count once
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                    if size >= BLOCK_MEMBERS:
                        yield repeats()
                        held, size, seen = [], 0, set()
            yield _batch(0, ids, sizes, ones, twos)
        if held:
            yield repeats()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)


def _batch(kind: int, ids, n, one, two) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    arrays = [pa.array(np.full(len(ids), kind, dtype=np.int32)), ids if isinstance(ids, pa.Array) else pa.array(ids), pa.array(n.astype(np.int64)), none if one is None else pa.array(one), none if two is None else pa.array(two)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "id", "n", "f1", "f2"])


def frequent(scanned: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, classes) of the most frequent ones: class c stands for about 2**c repeats. At most `most`."""
    counts = scanned.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).withColumn("class", F.floor(F.log2("n")).cast("int"))
    counts = materialise(counts.select("id", "class"), "frequent")
    sizes = {r["class"]: r["count"] for r in counts.groupBy("class").count().collect()}
    total, least = 0, 64
    for c in sorted(sizes, reverse=True):
        if total + sizes[c] > most:
            break
        total, least = total + sizes[c], c
    rows = counts.where(F.col("class") >= least).select("id", F.col("class").cast("tinyint").alias("class")).toArrow()
    ids, classes = rows["id"].to_numpy().view(np.uint64), rows["class"].to_numpy().view(np.uint8)
    order = np.argsort(ids)
    return ids[order], classes[order]


def prefix(s: np.ndarray, hot: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, int, float]:
    """(members of the chosen prefix, l, the share of frequent ones among the first n - alpha + 1)."""
    n, alpha = len(s), need(len(s), percent)
    cls = np.zeros(n, dtype=np.uint8)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        cls = np.where(hot[at] == s, classes[at], 0).astype(np.uint8)
    most = min(MATCHES, alpha)
    upto = n - alpha + most
    order = np.argsort(cls, kind="stable")[:upto]
    posts = np.cumsum(np.where(cls[order] > 0, np.exp2(cls[order].astype(np.float64)), 0.0))
    l_ = np.arange(1, most + 1)
    reach = posts[n - alpha + l_ - 1]  # postings read at each l
    cost = reach + 2.0 * (n - alpha + l_) + VERIFY_COST * reach / l_
    chosen = int(np.argmin(cost)) + 1
    return s[order[: n - alpha + chosen]], chosen, float((cls[order[: n - alpha + 1]] > 0).mean())


def sketch(s: np.ndarray) -> bytes:
    """How many members fall into each of about a quarter as many cells; empty if a count takes more than a byte."""
    cells = 1 << max(0, (len(s) // 4 - 1).bit_length())
    counts = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def possible(one: bytes, two: bytes, percent: int) -> bool:
    """Whether two sets of these sketches can be as similar as asked: they share at most the smaller count of each cell."""
    if not one or not two:
        return True
    x, y = (np.frombuffer(b, np.uint8).astype(np.int64) for b in (one, two))
    n, cells = int(x.sum() + y.sum()), min(len(x), len(y))
    most = int(np.minimum(x.reshape(-1, cells).sum(0), y.reshape(-1, cells).sum(0)).sum())
    return most * 100 >= percent * (n - most)


def prefixes(docs: DataFrame, hot: np.ndarray, classes: np.ndarray, percent: int, words: int = WORDS) -> DataFrame:
    """(doc, n, l, central, sketch, tokens) of each document that has a member.

    central is higher the fewer members of its own a document has; its last digits, by a hash, break ties.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (hot, classes) = Shingler(words), shared.value
        for b in (part for batch in batches for part in slices(batch, 1)):
            ids, out, keep, sizes, chosen, central, cells, ends, total = b.column(0), [], [], [], [], [], [], [0], 0
            for k, s in shingler.sets(texts_of(b.column(1))):
                if not len(s):
                    continue
                members, l_, common = prefix(s, hot, classes, percent)
                keep.append(k)
                sizes.append(len(s))
                chosen.append(l_)
                central.append(round(common, 2) + float(s[-1] & np.uint64(0xFFFFF)) / (1 << 40))
                cells.append(sketch(s))
                out.append(members)
                total += len(members)
                ends.append(total)
            if keep:
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(sizes, pa.int32()), pa.array(chosen, pa.int32()), pa.array(central), pa.array(cells, pa.binary()), tokens], names=["doc", "n", "l", "central", "sketch", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, n int, l int, central double, sketch binary, tokens array<long>")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Those of pairs (a, b) of distinct doc_ids whose sets are as similar as asked: whole texts are hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in (part for batch in batches for part in slices(batch, 2, 3)):
            a, b = batch.column(0), batch.column(1)
            ta, tb = texts_of(batch.column(2)), texts_of(batch.column(3))
            distinct = {t: k for k, t in enumerate(dict.fromkeys(ta + tb))}
            sets = dict(shingler.sets(list(distinct)))
            keep = []
            for k in range(batch.num_rows):
                x, y = sets[distinct[ta[k]]], sets[distinct[tb[k]]]
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                same = len(x) + len(y) - len(np.union1d(x, y))
                if same * 100 >= percent * (len(x) + len(y) - same):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], names=["a", "b"])

    # only the texts that are asked for go on to the two joins
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    some = materialise(docs.join(asked, "doc_id", "left_semi").select("doc_id", "text"), "asked-texts")
    left, right = (some.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    full = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    out = materialise(full.mapInArrow(run, "a long, b long"), "links")
    discard(some)
    return out


def plausible(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that their sketches don't rule out; a sketch is some twentieth of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = pa.array([k for k, (x, y) in enumerate(zip(ones, twos, strict=True)) if possible(x, y, percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    of = lambda x: held.select(F.col("doc").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "sketch_a", "sketch_b")
    return materialise(both.mapInArrow(run, "a long, b long").distinct(), "plausible")


def enough(votes: DataFrame, longer: DataFrame) -> DataFrame:
    """The rows of votes (a, b, shared) that share as many as the smaller l of the two. longer: (doc, l > 1)."""
    l_of = lambda x: longer.select(F.col("doc").alias(x), F.col("l").alias(f"l_{x}"))
    both = votes.join(l_of("a"), "a", "left").join(l_of("b"), "b", "left")
    return both.where(F.col("shared") >= F.least(F.coalesce("l_a", F.lit(1)), F.coalesce("l_b", F.lit(1)))).select("a", "b", "shared")


def groups(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, n_shingles, component_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialise(scan(texts, words), "shingle-scan")
    sized = scanned.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "f1", "f2")
    same = materialise(sized.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    hot, classes = frequent(scanned)
    # one document stands for each class of equal sets
    reps = texts.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    held = materialise(prefixes(reps, hot, classes, percent, words), "prefixes")
    longer = held.where("l > 1").select("doc", "l")

    posts = held.select("doc", "central", "n", "l", F.posexplode("tokens").alias("pos", "token"))
    lowest = posts.groupBy("token").agg(F.max_by("doc", "central").alias("hub"), F.count("*").alias("k")).where("k > 1")
    lowest = materialise(lowest.select("token", "hub"), "hubs")
    more = materialise(posts.select("token", "doc", "n", "l", (F.col("pos") + 1).alias("pos")).join(lowest, "token"), "crowded")
    votes = more.where("hub <> doc").groupBy(F.col("hub").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("shared"))
    # a document asks the hub that it shares most with; what that leaves apart is compared below
    best = enough(votes, longer).groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    asked = materialise(best.select("a", "b"), "hub-pairs")
    links = verified(plausible(asked, held, percent), texts, percent, words)
    found = components(links)

    # shingles whose documents are still apart; a document without links is its own component
    placed = more.drop("hub").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    placed = materialise(placed, "placed")
    apart = placed.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("k")).where("x < y")
    still = materialise(placed.join(apart.select("token", "k"), "token"), "apart")
    discard(lowest, more, placed)
    sides = lambda rows, *keys: (rows.select("token", *keys, F.col("doc").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("label", "n", "l", "pos", "part") if c in rows.columns)) for s in "ab")
    x, y = sides(still)
    # the overlap that two sets of these sizes need, and so how far their first l shared members may stand
    overlap = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    upto = lambda l_: (F.col("pos_a") <= F.col("n_a") - overlap + l_) & (F.col("pos_b") <= F.col("n_b") - overlap + l_)
    # those that share l members so far share one of all but the l - 1 most frequent: these need no postings, nor do
    # places that no partner's size allows. Block i meets every block j >= i
    early = still.where(F.col("pos") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1)
    early = early.withColumn("parts", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
    early = early.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    u, v = sides(early, "i", "j")
    apart_blocks = (F.col("i") == F.col("j")) | (F.col("part_a") != F.col("part_b"))
    met = u.join(v, ["token", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & apart_blocks & upto(1))
    cross = met.groupBy("a", "b").agg(F.lit(1).alias("shared"))
    asked = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cross = plausible(cross.join(asked, ["a", "b"], "left_anti"), held, percent)
    least = F.least("l_a", "l_b")
    counted = cross.join(x, "a").join(y, ["b", "token"]).where(upto(least))
    cross = counted.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(least).alias("l")).where("shared >= l").select("a", "b")
    cross = materialise(cross, "cross-pairs")
    if not cross.isEmpty():
        found = components(links.union(verified(cross, texts, percent, words)))
    discard(held, still, cross)
    by_set = same.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("label", "rep").alias("component"))
    out = sized.join(by_set, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
