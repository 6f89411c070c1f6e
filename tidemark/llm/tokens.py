"""Token ids in binary shards, each a wavelet matrix.

A shard file holds the ids of consecutive documents of one range of doc_id:

    magic "TMWM0001" | header length (u32) | header (JSON) | sections, each compressed with Zstandard

The header names the sections: "docs" (doc ids, i64), "ends" (ids of the shard up to and with each document, i64), and
"plane b" for each bit b from the highest: the bits of all ids in that plane's order, packed, then a count of ones
before each block of 512 bits (u32). zeros[b] is the number of zero bits of plane b. With that, access, rank (how often
an id stands before a place) and select (where its k-th occurrence is) take one step a plane and read no ids.

Cases: null text counts as empty; an empty document is the end id alone; equal doc_ids keep the order of their text,
and are written once each; an empty table gives no shard and no rows; other columns are ignored; a null doc_id
sorts first and is kept as null.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, read_file, texts_of, write_file

MAGIC = b"TMWM0001"
RANK_BITS = 512
#: Pieces of words of which a task keeps the ids; beyond it starts anew, so memory is bounded.
KEPT_WORDS = 500_000
#: A shard is closed once it holds so many ids.
SHARD_TOKENS = 2_000_000
#: Texts are encoded together until they have so many characters.
CHUNK_CHARS = 1_000_000
#: Latin letters as _latin() takes them, then signs: a word of two pieces where the tokenizer says so. No apostrophes, which
#: may belong to letters.
TAILED = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<signs>[!-&(-/:-@\[-`{-~]+)$"
NULL_ID = -(1 << 63)


#: Texts on which a tokenizer must treat words by themselves for their ids to be kept; with white space of all kinds.
PROBE = ["one two", "a b.c, d", "It's  \n\tDon't", "x\ty\nz w", " lead trail ", "9 9,9. 9", "É é ab AB", "<s> [CLS] a", "日本 語 a"]


class WordEncoder:
    """Encodes with a tokenizer that drops white space and never joins words over it: each word's ids are found once.

    Whether a tokenizer is such a one is tried on PROBE (and its parts: a normalizer, a pre-tokenizer and a model);
    any other encodes whole texts. Words not seen yet go through the library's normalizer and pre-tokenizer together, and
    each new piece of them through its model. Words with odd white space or special tokens are encoded by themselves.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        alone = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        parts = self.tokenizer.normalizer is not None and self.tokenizer.pre_tokenizer is not None
        self.by_word = parts and all(alone(t) == [i for w in re.split("[ \\n\\t]", t) if w for i in alone(w)] for t in PROBE)
        if not self.by_word:
            return
        normal, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = _Letters(split)
        # whether Latin letters are one piece as they are, and signs after them another
        some, pieces = "abcéßñœ", lambda t: [x for x, _ in split(t)]
        alike = normal(some) == some and pieces(some) == [some.translate(self.letters)] and not any(t.isalpha() for t in self.special)
        self.lowers = alike and normal("AZÉÑ") == "azéñ"
        self.by_letters = alike and (self.lowers or normal("AZÉÑ") == "AZÉÑ")
        self.parts = self.by_letters and all(pieces(some + t) == [some.translate(self.letters), t] for t in (",", ".", "!!", "?!", "&&&", "-_:;", "***")) and all(any(c.isalpha() for c in t) for t in self.special)
        self.clear()

    def clear(self) -> None:
        self.index = _Numbered(self.lowers, self.by_letters)
        self.pieces: dict[str, bytes] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _words_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes: small to keep and quick to join."""
        normal = self.tokenizer.normalizer.normalize_str(" ".join(words))
        parts = normal.split(" ")
        if len(parts) != len(words) or any(x in normal for x in self.special) or not normal.isprintable():
            return [self._alone(w) for w in words]
        at, end, known, model, out = -1, -1, self.pieces, self.tokenizer.model, [b""] * len(words)
        for piece, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            while start > end:
                at += 1
                end += len(parts[at]) + 1
            if (found := known.get(piece)) is None:
                found = known[piece] = array("I", [t.id for t in model.tokenize(piece)]).tobytes()
            out[at] += found
        return out

    def _alone(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self) -> None:
        """The ids of pieces numbered since the last time: of letters by the model, else by the library's normalizer and
        pre-tokenizer, many at once."""
        flat, ends = array("I"), [0]
        other = [w for w, letters in self.index.new if not letters and w.isprintable()]
        found = {}
        for k in range(0, len(other), 500):
            found.update(zip(other[k : k + 500], self._words_ids(other[k : k + 500]), strict=True))
        tokenize, spelled = self.tokenizer.model.tokenize, self.letters
        for word, letters in self.index.new:
            if letters:
                flat.extend([t.id for t in tokenize(word if word.isascii() else word.translate(spelled))])
            else:
                flat.frombytes(found[word] if word in found else self._alone(word))
            ends.append(len(flat))
        self.index.new = []
        at = np.array(ends, dtype=np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + at[:-1]))
        self.counts = np.concatenate((self.counts, np.diff(at)))
        self.flat = np.concatenate((self.flat, np.frombuffer(flat, np.uint32)))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        known = coded.dictionary
        numbers = np.fromiter(map(self.index.__getitem__, known.to_numpy(zero_copy_only=False)), np.int64, len(known))
        return numbers[coded.indices.to_numpy()]

    def _split(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word's first piece and its signs after letters, empty for most; letters of ASCII in lower case where it is all one."""
        tails = pa.scalar("", pa.large_string())
        if self.parts:
            plain = pc.ascii_is_alpha(words)
            cut = pc.extract_regex(pc.if_else(plain, tails, words), TAILED)  # null where there are no two
            two = cut.is_valid()
            words, tails = pc.if_else(two, cut.field("letters"), words), pc.if_else(two, cut.field("signs"), tails)
        else:
            tails = pa.repeat(tails, len(words))
        return pc.if_else(pc.ascii_is_alpha(words), pc.ascii_lower(words), words) if self.lowers else words, tails

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, end of each text among them)."""
        if not self.by_word:
            rows = [[*e.ids, end] for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter((i for r in rows for i in r), np.uint32, sum(map(len, rows))), np.cumsum([len(r) for r in rows])
        if len(self.index) > KEPT_WORDS:
            self.clear()
        # these are white space to any tokenizer and stand in no composed character
        plain = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), "\t", " ")
        words = pc.split_pattern(plain, " ")
        coded = words.flatten().dictionary_encode()  # so that each word is taken apart once for all texts
        pieces = np.stack([self._numbers(x) for x in self._split(coded.dictionary)], axis=1)
        self._learn()
        own, upto = _gather(self.flat, self.starts, self.counts, pieces.ravel())
        counts = np.diff(upto[1::2], prepend=0)
        ids, upto = _gather(own, upto[1::2] - counts, counts, coded.indices.to_numpy())
        ends = upto[words.offsets.to_numpy()[1:] - 1]
        return np.insert(ids, ends, np.uint32(end)), ends + np.arange(1, len(texts) + 1)


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parts of flat at these places, one after another, end of each among them)."""
    n = counts[places]
    upto = np.cumsum(n)
    return flat[np.arange(upto[-1]) + np.repeat(starts[places] - upto + n, n)], upto


class _Letters(dict):
    """What the pre-tokenizer makes of a letter, for str.translate."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, code: int) -> str:
        out = self[code] = self.split(chr(code))[0][0]
        return out


def _latin(word: str) -> bool:
    """Letters only, all of them composed Latin ones, which stay as they are under canonical composition, and one letter each in
    lower case (a dotted capital I does not)."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)


class _Numbered(dict):
    """Numbers pieces as they are asked for. new holds (piece, whether it is Latin letters) of those since it was last emptied.

    lowers: Latin letters count as their lower-case form.
    """

    def __init__(self, lowers: bool, by_letters: bool):
        super().__init__({"": 0})
        self.lowers, self.by_letters, self.n, self.new = lowers, by_letters, 1, []

    def __missing__(self, key: str) -> int:
        letters = self.by_letters and _latin(key)
        if letters and self.lowers and (low := key.lower()) != key:
            n = self[key] = self[low]
            return n
        self[key] = n = self.n
        self.n += 1
        self.new.append((key, letters))
        return n


@lru_cache(1)
def encoder_of(vocabulary: str) -> WordEncoder:
    """One for a Python worker, which runs many tasks. Tasks that read shards let it go: its words take much memory."""
    return WordEncoder(vocabulary)


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank directories."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks, zeros, now = [], [], [], ids.astype(np.uint32 if bits > 16 else np.uint16)
        for b in reversed(range(bits)):
            bit = (now & now.dtype.type(1 << b)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (RANK_BITS // 8)))).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32))))
            low = np.compress(~bit, now)
            zeros.append(len(low))
            now = np.concatenate((low, np.compress(bit, now)))
        return cls(len(ids), planes, ranks, zeros)

    def _rank1(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block = i // RANK_BITS
        start, whole = block * RANK_BITS // 8, i // 8
        n = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][start:whole]).sum())
        return n + ((int(self.planes[k][whole]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        out = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, i)
            out = out << 1 | bit
            i = self.zeros[k] + self._rank1(k, i) if bit else i - self._rank1(k, i)
        return out

    def _down(self, token: int, i: int) -> tuple[int, int]:
        """(start of the token's run in the last order, place that i falls to)."""
        low = 0
        for k in range(len(self.planes)):
            if token >> (len(self.planes) - 1 - k) & 1:
                low, i = self.zeros[k] + self._rank1(k, low), self.zeros[k] + self._rank1(k, i)
            else:
                low, i = low - self._rank1(k, low), i - self._rank1(k, i)
        return low, i

    def rank(self, token: int, i: int) -> int:
        """How often token stands before place i."""
        low, high = self._down(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of occurrence k (from 0); -1 if there are fewer."""
        low, high = self._down(token, self.n)
        if k >= high - low:
            return -1
        i = low + k
        for p in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - p) & 1
            want = i - self.zeros[p] if one else i
            a, b = 0, self.n  # the place whose bit is the wanted one of its kind
            while a < b:
                mid = (a + b) // 2
                seen = self._rank1(p, mid + 1)
                a, b = (mid + 1, b) if (seen if one else mid + 1 - seen) <= want else (a, mid)
            i = a
        return i

    def ids(self) -> np.ndarray:
        """All ids: the last order is sorted, and each plane undoes its split."""
        now = None
        for k in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            place = len(self.planes) - 1 - k
            if now is None:
                now = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
            now[self.zeros[k] :] |= now.dtype.type(1 << place)
            out = np.empty_like(now)
            out[np.flatnonzero(~bit)], out[np.flatnonzero(bit)] = now[: self.zeros[k]], now[self.zeros[k] :]
            now = out
        return np.zeros(0, np.uint32) if now is None else now.astype(np.uint32)


def pack_shard(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    wm, sections, body = WaveletMatrix.build(ids, bits), [], []
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for name, data in [("docs", doc_ids.tobytes()), ("ends", ends.tobytes())] + [(f"plane {k}", p.tobytes() + r.tobytes()) for k, (p, r) in enumerate(zip(wm.planes, wm.ranks, strict=True))]:
        body.append(squeeze(data))
        sections.append([name, len(body[-1])])
    header = json.dumps({"n": wm.n, "bits": bits, "zeros": wm.zeros, "sections": sections}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *body])


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, ends, wavelet matrix) of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    at = 12 + int.from_bytes(data[8:12], "little")
    header, expand, parts = json.loads(data[12:at]), zstandard.ZstdDecompressor().decompress, []
    for _, size in header["sections"]:
        parts.append(expand(data[at : at + size]))
        at += size
    cut = (header["n"] + 7) // 8
    planes = [np.frombuffer(p[:cut], np.uint8) for p in parts[2:]]
    ranks = [np.frombuffer(p[cut:], np.uint32) for p in parts[2:]]
    return np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.int64), WaveletMatrix(header["n"], planes, ranks, header["zeros"])


MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, folder: str, shard_tokens: int = SHARD_TOKENS, order: list[Column] | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order into shard files under folder; returns the manifest, written.

    order: columns to go by instead, which no two rows should share. Ranges of the order go to one task each; a task streams its rows and closes a shard at shard_tokens, so memory is
    bounded by a shard and the longest document. A lost task writes its files again under other names; only the names
    of tasks that ended are in the manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = encoder_of(vocabulary), TaskContext.get().partitionId(), 0
        bits = max(1, int(max(encoder.size - 1, end_id)).bit_length())
        docs, held, size = [], [], 0

        def close():
            nonlocal docs, held, size, shard
            ends = np.cumsum([len(h) for h in held], dtype=np.int64)
            path = f"{folder}/{part:06d}-{shard:05d}-{uuid.uuid4().hex}.tmwm"
            write_file(path, [pack_shard(np.array(docs, dtype=np.int64), ends, np.concatenate(held), bits)])
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path, "n_docs": len(docs), "n_tokens": int(ends[-1])}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            docs, held, size, shard = [], [], 0, shard + 1
            return row

        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            first, chars = 0, 0
            for k, text in enumerate(texts):
                chars += len(text)
                if chars < min(CHUNK_CHARS, 4 * shard_tokens) and k + 1 < len(texts):
                    continue
                ids, ends = encoder.encode(texts[first : k + 1], end_id)
                docs += [NULL_ID if doc is None else doc for doc in ids_of[first : k + 1]]
                held += np.split(ids, ends[:-1])
                size, first, chars = size + len(ids), k + 1, 0
                if size >= shard_tokens:
                    yield close()
        if docs:
            yield close()

    thin = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if order:
        keyed = docs.select(*thin, F.struct(*order).alias("place"))
        ordered = keyed.repartitionByRange("place").sortWithinPartitions("place").select("doc_id", "text")
    else:
        # equal ids are spread by a hash of the text, so that no single id makes a task of its own
        by_id = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
        ordered = docs.select(*thin).repartitionByRange(*by_id).sortWithinPartitions(*by_id, "text")
    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each shard: sums by part first, so that only a row a part meets in one place; within
    a part, a running sum."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_docs").alias("docs"))
    # a row for each of Spark's partitions, however large the corpus: the driver adds them up
    rows, base, docs, table = sorted(parts.collect(), key=lambda r: r["part"]), 0, 0, []
    for r in rows:
        table.append((r["part"], base, docs))
        base, docs = base + r["tokens"], docs + r["docs"]
    before = manifest.sparkSession.createDataFrame(table, "part int, base long, base_docs long")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.select("part", "shard", "path", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("inside"))
    return within.join(before, "part").select("part", "shard", "path", (F.col("base") + F.col("inside")).alias("start"))


def read_shards(starts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, decoded from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_of.cache_clear()
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, ends, wm = unpack_shard(read_file(path))
                ids = wm.ids()
                firsts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(firsts, ends, strict=True)]
                for k in range(0, len(docs), 2000):
                    s = slice(k, k + 2000)
                    cut = np.concatenate((firsts[s], ends[s][-1:])) - firsts[k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if d == NULL_ID else d for d in docs[s].tolist()], pa.int64()), pa.array(firsts[s] + base), pa.array(ends[s] - firsts[s]), pa.array(crc[s], pa.int64()), pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(ids[firsts[k] : ends[s][-1]].astype(np.int32)))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    paths = starts.select("path", "start")
    spread = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def digests(starts: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32; the ids stay in the task that reads them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_of.cache_clear()
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, ends, wm = unpack_shard(read_file(path))
                raw = memoryview(wm.ids().astype("<u4").tobytes())
                firsts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(firsts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([None if d == NULL_ID else d for d in docs.tolist()], pa.int64()), pa.array(firsts + base), pa.array(ends - firsts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    paths = starts.select("path", "start")
    spread = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Writes docs as token shards, in ascending doc_id order or that of the columns given, and reads their digests back."""
    folder = folder or new_path(docs.sparkSession, "token-shards")
    return digests(shard_starts(write_shards(docs, vocabulary, end_id, folder, order=order)))
