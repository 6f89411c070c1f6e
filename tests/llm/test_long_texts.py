"""Texts of a megabyte that are all exceptions, fragments of notices or spans of secrets: no more than in proportion; and the same as plain loops."""

import random
import time

import public_tokenizers
import pytest

from tidemark.llm import licenses, secrets, toxicity
from tidemark.llm.queries import vocabulary


def took(f):
    start = time.perf_counter()
    out = f()
    return out, time.perf_counter() - start


def test_exceptions_that_fill_a_text():
    lexicon = toxicity.Lexicon({toxicity.fold(w): toxicity.SEED_WEIGHT for w in toxicity.SEED})
    automaton = lexicon.automaton()
    phrase = next(iter(lexicon.exceptions))
    (_, _, hits), seconds = took(lambda: toxicity.features(f"{phrase} " * ((1 << 20) // (len(phrase) + 1)), automaton))
    assert hits == 0 and seconds < 20
    rng, words = random.Random(1), [*toxicity.SEED, *lexicon.exceptions, "plain", "x"]
    for _ in range(200):
        text = " ".join(rng.choices(words, k=rng.randint(1, 30)))
        t, starts, harmless = toxicity.fold(text), {}, []
        for last, (size, kinds) in automaton.iter(t):
            a, b = last + 1 - size, last + 1
            if not (a and t[a - 1].isalnum()):
                whole = b == len(t) or not t[b].isalnum()
                harmless += [(a, b)] if whole and "except" in kinds else []
                weight = max(kinds.get("word", 0.0) if whole else 0.0, kinds.get("stem", 0.0))
                if weight > starts.get(a, (0.0, 0))[0]:
                    starts[a] = (weight, b)
        plain = [w for a, (w, b) in starts.items() if not any(x <= a and b <= y for x, y in harmless)]
        assert toxicity.features(text, automaton)[2] == len(plain)


@pytest.fixture(scope="module")
def test():
    return secrets.TokenTest(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, secrets.RATIO)


def test_spans_that_fill_a_text(test):
    text = "password=hunter22x qZ8vT3xLw0pRk7mNb2cJ " * 26_000
    base = secrets.base_spans(text)
    spans, seconds = took(lambda: secrets.token_spans(text, test, base))
    assert len(base) == 26_000 and len(spans) == 26_000 and seconds < 30


def test_overlaps_are_those_of_all_pairs(test, monkeypatch):
    rng = random.Random(2)
    always = lambda s: len(s) > 0
    for _ in range(300):
        text = "".join(rng.choice("aB3 =") for _ in range(400))
        taken = [("hex", a, a + rng.randint(1, 40)) for a in (rng.randrange(400) for _ in range(rng.randint(0, 6)))]
        plain = [(a, b) for _, a, b in secrets.token_spans(text, always, []) if not any(x < b and a < y for _, x, y in taken)]
        assert [(a, b) for _, a, b in secrets.token_spans(text, always, taken)] == plain


def test_fragments_of_notices_that_fill_a_text():
    notices = licenses.Notices(licenses.NOTICES)
    text = "permission to use copy modify the " * 30_000
    found, seconds = took(lambda: notices.found(text))
    assert not found and seconds < 60
    notice = "permission to use copy modify and or distribute this software for any purpose"
    found = notices.found(f"{text}{notice.replace('modify', 'modfy')} {text[:5000]}")
    assert [(label, edits) for label, _, _, edits, _ in found] == [("isc", 1)]


def test_near_holds_all_matches():
    import regex

    rng = random.Random(3)
    for _ in range(400):
        pattern, text, k = "".join(rng.choices("abc", k=rng.randint(4, 12))), "".join(rng.choices("abcd", k=rng.randint(0, 60))), rng.randint(0, 3)
        parts, fuzzy = licenses.near(pattern, k, text), regex.compile(f"(?:{pattern}){{e<={k}}}")
        ends = {b for b in range(len(text) + 1) for a in range(max(0, b - len(pattern) - k), b + 1) if fuzzy.fullmatch(text, a, b)}
        assert bool(parts) == bool(ends) and all(any(x < e <= y for x, y in parts) for e in ends)
        assert all(y < x for (_, y), (x, _) in zip(parts, parts[1:], strict=False))


def test_long_parts_give_what_the_search_alone_gives(monkeypatch):
    rng = random.Random(4)
    notices = licenses.Notices({"under the mit license": "mit", "licensed under cc by nc 4 0": "nc", "permission to use copy modify": "isc"})
    words = "under the mit license licensed cc by nc 4 0 permission to use copy modify lisence teh perm".split()
    for _ in range(120):
        text = " ".join(rng.choices(words, k=80))
        monkeypatch.setattr(licenses, "LONG_PART", 1 << 30)
        plain = notices.found(text)
        monkeypatch.setattr(licenses, "LONG_PART", 40)
        assert notices.found(text) == plain
