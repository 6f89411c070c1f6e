"""License scans: fixed phrases, and short notices found with edits.

Texts are folded to lower-case words (runs of ASCII letters and digits and of all other characters above U+007F) with
one space between. The base finds where a phrase's words stand one after another. The search for notices allows each
one an error budget of a twelfth of its length: cut into budget + 1 pieces, any text within the budget holds a piece
unchanged, so an Aho-Corasick automaton of the pieces locates candidates; in a window around each, the regex library's
bounded-error matching verifies the edits and gives the span. The words that tell a license from its kin (nc from nd, gnu
general from gnu lesser) must stand in the span as they are. Of spans that overlap, the one with the least share of edits stays.

Cases: null and empty texts have no words and no labels; a phrase counts at each of its places, also in texts that
repeat; documents that repeat are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wording of well-known notices, folded, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution noncommercial 4 0": "cc-by-nc",
    "creative commons attribution noderivatives 4 0": "cc-by-nd",
    "creative commons attribution sharealike 4 0": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "under the terms of the mozilla public license": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# Words that a notice's span must hold unedited, side by side; notices not named need none.
EXACT = {
    "under the mit license": ["mit"],
    "licensed under the apache license version 2 0": ["apache", "version 2"],
    "licensed under cc by nc 4 0": ["by nc"],
    "licensed under cc by nd 4 0": ["by nd"],
    "licensed under cc by nc sa 4 0": ["by nc sa"],
    "licensed under cc by nc nd 4 0": ["by nc nd"],
    "licensed under cc by sa 4 0": ["by sa"],
    "licensed under cc by 4 0": ["cc by"],
    "creative commons attribution noncommercial 4 0": ["noncommercial"],
    "creative commons attribution noderivatives 4 0": ["noderivatives"],
    "creative commons attribution sharealike 4 0": ["sharealike"],
    "under the terms of the gnu general public license": ["gnu general"],
    "under the terms of the gnu lesser general public license": ["lesser"],
    "under the terms of the gnu affero general public license": ["affero"],
    "under the terms of the mozilla public license": ["mozilla"],
}
EDIT_SHARE, LEAST_PIECE = 12, 7
#: Characters above which a part is looked through for any match first.
LONG_PART = 300
APART = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fold(text: str) -> str:
    """The words with one space between."""
    return APART.sub(" ", text.lower() if text.isascii() else text.translate(LOWER)).strip(" ")


def places(words: str, phrase: str) -> list[int]:
    """Where a phrase's words stand in folded words, as numbers of words from 0."""
    padded, sought, out, at, n, seen = f" {words} ", f" {phrase} ", [], -1, 0, 0
    while (at := padded.find(sought, at + 1)) >= 0:
        n += padded.count(" ", seen, at)
        seen = at
        out.append(n)
    return out


def near(pattern: str, edits: int, text: str) -> list[tuple[int, int]]:
    """The parts of text, apart and in order, that all matches within so many edits of pattern lie in: those that reach back
    from each place where one ends. By bit-parallel columns, a few steps a character."""
    out: list[tuple[int, int]] = []
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = (down | ~(across | up)) & full, up & across
        score += bool(more & high) - bool(less & high)
        if score <= edits:
            begin = max(0, at - len(pattern) - edits)
            out[-1:] = [(out[-1][0], at)] if out and begin <= out[-1][1] else [*out[-1:], (begin, at)]
        more, less, sides = more << 1 & full, less << 1 & full, same | down
        up, down = (less | ~(sides | more)) & full, more & sides
    return out


class Notices:
    """The automaton of all notices' pieces and their bounded-error patterns."""

    def __init__(self, notices: dict[str, str]):
        import ahocorasick
        import regex

        self.items, self.automaton, seeds = [], ahocorasick.Automaton(), {}
        for n, (text, label) in enumerate(notices.items()):
            k = max(0, min(len(text) // EDIT_SHARE, len(text) // LEAST_PIECE - 1))
            self.items.append((text, label, k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}")))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((n, a))
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if seeds:
            self.automaton.make_automaton()

    def found(self, words: str) -> set[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, length of the notice) of each notice found, in folded characters."""
        if not self.items:
            return set()
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(words):
            for n, at in uses:
                text, _, k, _ = self.items[n]
                start = last + 1 - size - at
                low, high = max(0, start - k), start + len(text) + k
                spans = windows.setdefault(n, [])
                if spans and low <= spans[-1][1]:
                    spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
                else:
                    spans.append((low, high))
        out = set()
        for n, spans in windows.items():
            text, label, k, pattern = self.items[n]
            exact = EXACT.get(text, [])
            for low, high in spans:
                parts = [(low, min(high, len(words)))]
                while parts:  # the best match of a part, then what stands before and after it
                    a, b = parts.pop()
                    # of long parts, only those that hold matches go on to the slower search for the best one
                    if b - a > LONG_PART:
                        inner = [(a + x, a + y) for x, y in near(text, k, words[a:b])]
                        if inner != [(a, b)]:
                            parts += inner
                            continue
                    if m := pattern.search(words, a, b):
                        if all(f" {x} " in f" {m[0]} " for x in exact):
                            out.add((label, m.start(), m.end(), sum(m.fuzzy_counts), len(text)))
                        parts += [(a, m.start()), (m.end(), b)]
        return out

    def __call__(self, words: str) -> list[tuple[str, int, int, int, int]]:
        """found(), in order, and of spans that overlap only the one with the least share of edits."""
        kept: list[tuple[int, int, tuple]] = []
        for x in sorted(self.found(words), key=lambda x: (x[3] / x[4], -x[4], x[1], x[0])):
            at = bisect_left(kept, (x[1], x[2]))  # kept spans are apart, so only the two beside it can overlap
            if (at == 0 or kept[at - 1][1] <= x[1]) and (at == len(kept) or x[2] <= kept[at][0]):
                kept.insert(at, (x[1], x[2], x))
        return [x for *_, x in kept]


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:long,end:long,edits:long>>"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """A row for each document: the base's counts and places, all labels, a score, and the notices' spans in folded characters.

    The score is 1 where a base phrase stands, else 1 less the share of edits of the best notice, else 0.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Notices(notices)
        types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])))])
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                words = fold(text)
                at = {p: places(words, p) for p in phrases if p in words}
                base = sorted({phrases[p] for p, where in at.items() if where})
                starts = sorted(x for where in at.values() for x in where)
                found = find(words)
                score = 1.0 if starts else max((1.0 - edits / size for *_, edits, size in found), default=0.0)
                rows.append((doc, words.count(" ") + 1 if words else 0, len(starts), starts[0] if starts else None, starts[-1] if starts else None, base, sorted({*base, *(x[0] for x in found)}), max(0.0, score), [{"label": x[0], "start": x[1], "end": x[2], "edits": x[3]} for x in found]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)
