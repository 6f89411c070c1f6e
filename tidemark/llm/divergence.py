"""How far the sources of a language diverge from each other and from the language, by counts of its kept terms.

Terms are runs of letters (ASCII letters, and every character beyond ASCII), A-Z lower-cased; a language keeps those in at
least some number of its documents. Tasks count the terms of whole blocks of text by Arrow's dictionary encoding, and
send a count for each source and term, not words. One range shuffle by (language, term) brings all counts of a term
together in UTF-8 order; there a task cuts the kept terms into chunks. A chunk is a sorted array of kept terms; counts get
the ids that searchsorted finds in it. Since ids go up with UTF-8 order, ties by term are ties by id.

Chunks meet the totals of all sources of their language, and a bincount by (source, id) makes them dense vectors, some
columns at a time. From these come the value f of each pair of sources, added up over chunks, and each source's foremost
terms, of which a chunk sends the first few.

All arithmetic is on whole numbers. p = 1 + floor(10**9 * (count + 2) / (N + 2V)) is divided three digits at a time, so
it is exact up to N + 2V = 9e15 terms.

Cases: null text, lang and source are ''; a source without terms has N = 0 and takes part; a language that keeps no term
has pairs of value 0; repeated rows are documents each, whatever their ids; texts of any length are counted whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, WordHasher, discard, materialise, mix, slices

#: Kept terms of a chunk, and cells of a dense matrix of sources and terms.
CHUNK, CELLS = 1 << 13, 1 << 20
#: Counts that a task holds before it sends them.
HELD = 1 << 20
#: Bits of the map of frequent terms: 8 MB, whatever the input. More terms than it has bits are counted and left out later.
BITS = 1 << 26
#: What p is a fraction of: 1000 ** 3.
WHOLE = 1_000_000_000
#: Parts over which the totals of a language are repeated where they are too large to broadcast.
PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 64, 256, dtype=np.uint64)
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[:128] = False
_INSIDE[65:91] = _INSIDE[97:123] = True


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms as binary, index of each one's text) of all texts, in order. Null texts have none."""
    texts = texts.cast(pa.large_binary())
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data, at = data[at[0] : at[-1]], at - at[0]
    inside = _INSIDE[data]
    # a term starts after a separator, or where a text does
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[1:] > at[:-1]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    letters = _LOWER[data[inside]]
    # letters before each start
    before = np.cumsum(inside)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    offsets = np.append(before, len(letters)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    return terms, np.searchsorted(at, starts, side="right") - 1


def _block(b: pa.RecordBatch) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(groups, group of each text, text of each term, code of each term, coded terms, their hashes) of (lang, source, text)."""
    keys = pa.table({"lang": b.column("lang"), "source": b.column("source")})
    groups = keys.group_by(["lang", "source"], use_threads=False).aggregate([]).combine_chunks()
    name = lambda t: pc.binary_join_element_wise(pc.binary_length(t["lang"]).cast("string"), t["lang"], t["source"], ":")
    group = pc.index_in(name(keys).combine_chunks(), name(groups).combine_chunks()).to_numpy().astype(np.int64)
    terms, text = words(b.column("text"))
    coded = terms.dictionary_encode()
    return groups, group, text, coded.indices.to_numpy().astype(np.int64), coded.dictionary, _hashes(coded.dictionary)


def _hashes(terms: pa.Array) -> np.ndarray:
    """Hashes of binary terms, from sums of code(byte) * P**place. Equal terms have equal ones; others mostly not."""
    at = np.frombuffer(terms.buffers()[1], dtype=np.int64, count=len(terms) + 1, offset=8 * terms.offset)
    if at[0] == at[-1]:
        return np.zeros(len(terms), dtype=np.uint64)
    data = np.frombuffer(terms.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    powers, inverse = (WordHasher._power(p, len(data)) for p in (WordHasher.P, pow(WordHasher.P, -1, 1 << 64)))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * powers, out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]])


def _cells(one: np.ndarray, two: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of one and two (below size), and how often each occurs."""
    found, n = np.unique(one * size + two, return_counts=True)
    return found // size, found % size, n


def frequent(docs: DataFrame, least_docs: int) -> np.ndarray:
    """A bitmap of fixed size in which the bit of each (lang, term) with least_docs documents is set; few others are.

    Documents are counted by hashes, which are shorter than terms: those of equal hash add up, so none kept is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            return h[first], np.add.reduceat(n, first)

        def sent(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from pa.table({"hash": pa.array(h.view(np.int64)), "docs": pa.array(n)}).to_batches(max_chunksize=1 << 16)

        for whole in batches:
            for b in slices(whole, 2):
                groups, group, text, code, terms, hashes = _block(b)
                if not len(code):
                    continue
                text, code, _ = _cells(text, code, len(terms))
                langs, at = np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in groups["lang"].to_pylist()], dtype=np.uint64), return_inverse=True)
                of, code, n = _cells(at[group[text]], code, len(terms))
                held.append((hashes[code] ^ langs[of], n))
                size += len(n)
                if size > HELD:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > HELD // 2:  # what doesn't shrink goes on
                        yield from sent(*held[0])
                        held, size = [], 0
        if held:
            yield from sent(*summed())

    counted = docs.mapInArrow(run, "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    at = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    found = counted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bitmap = np.zeros(BITS // 64, dtype=np.uint64)
    bitmap[found["place"].to_numpy().astype(np.int64)] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return bitmap


def counts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it) of terms in the bitmap: one row a term of a source, written.

    A row with a null term stands for each (lang, source) that occurs.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.large_binary()), ("n", pa.int64()), ("docs", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def block(b: pa.RecordBatch) -> pa.Table:
        groups, group, text, code, terms, hashes = _block(b)
        langs = np.array([xxhash.xxh3_64_intdigest(x) for x in groups["lang"].to_pylist()], dtype=np.uint64)
        at = (hashes[code] ^ langs[group[text]]) & np.uint64(BITS - 1)
        some = np.flatnonzero(sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
        text, code, size = text[some], code[some], max(1, len(terms))
        g, t, n = _cells(group[text], code, size)
        of, code, _ = _cells(text, code, size)
        in_docs = _cells(group[of], code, size)[2]
        g, t = pa.array(g), pa.array(t)
        found = pa.Table.from_arrays([groups["lang"].combine_chunks().take(g), groups["source"].combine_chunks().take(g), terms.take(t), pa.array(n), pa.array(in_docs)], schema=schema)
        zero = pa.array(np.zeros(len(groups), dtype=np.int64))
        return pa.concat_tables([found, pa.Table.from_arrays([groups["lang"], groups["source"], pa.nulls(len(groups), pa.large_binary()), zero, zero], schema=schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(schema.names).cast(schema)

        for whole in batches:
            for b in slices(whole, 2):
                held.append(block(b))
                size += len(held[-1])
                if size > HELD:
                    held = [summed()]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield from held[0].to_batches(max_chunksize=10_000)
                        held, size = [], 0
        if held:
            yield from summed().to_batches(max_chunksize=10_000)

    found = docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return materialise(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def encode(counted: DataFrame, least_docs: int) -> DataFrame:
    """Chunks of kept terms: lang, terms (sorted), sources, totals (of each source here), cells of source, id and n."""
    schema = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("source_ix", pa.list_(pa.int32())), ("id", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def chunk(lang: str, terms: list[bytes], rows: list[tuple]) -> pa.RecordBatch:
        kept = np.empty(len(terms), dtype=object)
        kept[:] = terms
        ids = np.concatenate([np.repeat(np.searchsorted(kept, own), times) for own, times, _, _ in rows])
        coded = pa.concat_arrays([r[2] for r in rows]).dictionary_encode()
        n = np.concatenate([r[3] for r in rows])
        source = coded.indices.to_numpy()
        totals = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(totals, source, n)
        values = [lang, terms, coded.dictionary.to_pylist(), totals, source, ids.astype(np.int32), n]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, rows, left = None, [], [], None

        def take(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Adds whole terms, sorted, in order of (lang, term)."""
            nonlocal lang, terms, rows
            t = t.combine_chunks()
            codes = [t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
            n, docs, source = t["n"].to_numpy(), t["docs"].to_numpy(), t["source"].combine_chunks()
            starts = np.flatnonzero(np.append(True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])))
            times = np.diff(np.append(starts, len(n)))
            good = np.add.reduceat(docs, starts) >= least_docs
            starts, times = starts[good], times[good]
            own, at = t["term"].take(pa.array(starts)).to_pylist(), 0
            while at < len(starts):
                here = codes[0][starts[at]]
                name = t["lang"][int(starts[at])].as_py()
                if terms and (name != lang or len(terms) >= CHUNK):
                    yield chunk(lang, terms, rows)
                    terms, rows = [], []
                lang = name
                upto = min(len(starts), at + CHUNK - len(terms))
                other = np.flatnonzero(codes[0][starts[at:upto]] != here)
                upto = at + int(other[0]) if len(other) else upto
                piece = np.empty(upto - at, dtype=object)
                piece[:] = own[at:upto]
                terms.extend(own[at:upto])
                cells = np.repeat(starts[at:upto] - np.cumsum(times[at:upto]) + times[at:upto], times[at:upto]) + np.arange(times[at:upto].sum())
                rows.append((piece, times[at:upto], source.take(pa.array(cells)), n[cells]))
                at = upto

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([left, t]) if left is not None else t
            # the last term may go on in the next batch
            last = pc.and_(pc.equal(t["term"], t["term"][-1]), pc.equal(t["lang"], t["lang"][-1]))
            cut = len(t) - int(pc.sum(last).as_py())
            if cut:
                yield from take(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None and len(left):
            yield from take(left)
        if terms:
            yield chunk(lang, terms, rows)

    near = counted.where("term is not null").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    spec = "lang string, terms array<binary>, sources array<string>, totals array<long>, source_ix array<int>, id array<int>, n array<long>"
    return materialise(near.mapInArrow(run, spec), "term-chunks")


def p_of(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / whole), for count + 2 <= whole <= 9e15."""
    out, rest = np.zeros(np.broadcast_shapes(np.shape(count), np.shape(whole)), dtype=np.int64), count + 2
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); p and q are at most 10**9 + 1, so squares fit 64 bits."""
    d = p - q
    return d * d // (p + q)


def _compared(chunks: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, term, value: pair values added up over the chunks of a task, and the first terms of each chunk.

    chunks have names and sums (sources of the language, and N of each) and n_terms (V).
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("term", pa.binary()), ("value", pa.int64())])

    def batch(lang: str, source: list, part: str, item: list, term: list, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = pa.table([pa.array([lang] * len(source)), pa.array(source, pa.string()), pa.array([part] * len(source)), pa.array(item, pa.string()), pa.array(term, pa.binary()), pa.array(value, pa.int64())], schema=schema)
        yield from t.to_batches(max_chunksize=10_000)

    def pairs(lang: str, names: list[str], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, one in enumerate(names):
            others = [j for j in range(len(names)) if j != i]
            if others:
                yield from batch(lang, [one] * len(others), "pair", [names[j] for j in others], [None] * len(others), sums[i, others])

    def terms_of(lang: str, names: list[str], firsts: list) -> Iterator[pa.RecordBatch]:
        if firsts:
            yield from batch(lang, [names[s] for s, _, _ in firsts], "term", [None] * len(firsts), [t for _, t, _ in firsts], np.array([v for _, _, v in firsts], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, names, sums = None, [], np.zeros((0, 0), dtype=np.int64)
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                own = row["lang"].as_py()
                if own != lang:
                    if lang is not None:
                        yield from pairs(lang, names, sums)
                    lang, names = own, row["names"].as_py()
                    sums = np.zeros((len(names), len(names)), dtype=np.int64)
                if not row["terms"].is_valid:
                    continue  # a language that keeps no term
                v, kept = row["n_terms"].as_py(), row["terms"].as_py()
                whole = row["sums"].values.to_numpy() + 2 * v
                both = int(row["sums"].values.to_numpy().sum()) + 2 * v
                order = np.empty(len(names), dtype=object)
                order[:] = [x.encode() for x in names]
                here = np.array([x.encode() for x in row["sources"].as_py()], dtype=object)
                source = np.searchsorted(order, here)[row["source_ix"].values.to_numpy()]
                ids, n = row["id"].values.to_numpy(), row["n"].values.to_numpy()
                width, firsts = max(1, CELLS // max(1, len(names))), []
                for a in range(0, len(kept), width):
                    cols = min(width, len(kept) - a)
                    at = (ids >= a) & (ids < a + cols)
                    dense = np.bincount(source[at] * cols + ids[at] - a, n[at], minlength=len(names) * cols).astype(np.int64).reshape(len(names), cols)
                    p = p_of(dense, whole[:, None])
                    for i in range(len(names)):
                        sums[i] += gap(p, p[i]).sum(axis=1)
                    q = p_of(dense.sum(axis=0), both)
                    f = np.where((dense > 0) & (p > q), gap(p, q), -1)
                    for i in range(len(names)):
                        good = np.flatnonzero(f[i] >= 0)
                        best = good[np.argsort(-f[i][good], kind="stable")[:top]]  # ids go up with UTF-8 order
                        firsts += [(i, kept[a + j], int(f[i][j])) for j in best.tolist()]
                yield from terms_of(lang, names, firsts)
        if lang is not None:
            yield from pairs(lang, names, sums)

    return chunks.mapInArrow(run, "lang string, source string, part string, item string, term binary, value long")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank over docs (lang, source, text).

    Part pair: each other source of the language by its value; part term: the source's foremost terms, top of them.
    """
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = counts(d, frequent(d, least_docs))
    chunks = encode(counted, least_docs)
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left")
    groups = materialise(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "sources")
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    own = F.array_sort(F.collect_list(F.struct("source", "total")))
    langs = groups.groupBy("lang").agg(own.alias("s")).join(kept, "lang", "left")
    langs = materialise(langs.select("lang", F.col("s.source").alias("names"), F.col("s.total").alias("sums"), F.coalesce("n_terms", F.lit(0)).alias("n_terms")), "languages")
    size = groups.agg(F.sum(F.length("source") * 4 + 24)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = chunks.join(F.broadcast(langs), "lang")
    else:
        parts = chunks.withColumn("part", F.pmod(F.xxhash64("terms"), F.lit(PARTS)))
        met = parts.join(langs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["lang", "part"]).drop("part")
    none = langs.where("n_terms = 0").select("lang", *(F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in chunks.columns[1:]), "names", "sums", "n_terms")
    found = materialise(_compared(met.unionByName(none), top), "divergences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "part", F.col("term").cast("string").alias("item"), "value")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    discard(counted, chunks, groups)
    ranked = [x.withColumn("rank", F.row_number().over(w)) for x in (pairs, terms)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
