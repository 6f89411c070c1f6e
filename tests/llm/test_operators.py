"""Each operator on small tables against plain versions, with nulls, empty and long texts, repeats and extra columns."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, embeddings, jaccard, licenses, mixture, quality, secrets, tokens, toxicity, warc
from tidemark.llm.components import components
from tidemark.llm.queries import vocabulary

rng = random.Random(3)
WORDS = ["ta", "ro", "mi", "ne", "so", "lu", "ke", "va", "pé", "zu"]
prose = lambda n: " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))
LONG = prose(30_000)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_a string, hub string"


def docs(spark, texts):
    """A row a text, or (doc_id, text); with columns whose names clash with inner ones."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}" if i is not None else None, len(t or ""), "x", "y") for i, t in rows], DOCS)


EDGES = [None, "", " \n\t ", "one", "one two three", LONG]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(licenses.LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = prose(1)
    return " ".join(w)


def test_components_with_labels_too_many_to_broadcast(spark, monkeypatch):
    from tidemark.llm import components as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    edges = [(i, i + 1) for i in range(25)] + [(100, i) for i in range(101, 110)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(26)} | {i: 100 for i in range(100, 110)}


def test_words_of_any_length_hash_apart():
    """Also the words whose polynomial hashes modulo 2**64 are equal whatever the base."""
    from tidemark.llm.common import WordHasher

    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
        b = a.translate(str.maketrans("ab", "ba"))
        hasher = WordHasher(jaccard.SPACE)
        assert hasher.of(a) != hasher.of(b) and hasher.of(a.upper()) == hasher.of(a)
    got = hasher.words([f"x {a} y {b}".encode(), f"{a}".encode()])[0]
    assert got[1] == got[4] == hasher.of(a) and got[3] == hasher.of(b)


def test_jaccard_groups(spark):
    texts, passage = list(EDGES), prose(60)
    for _ in range(8):
        base = prose(rng.randint(8, 150))
        texts += [base, base, base.upper()] + [edited(base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06)]
    texts += [f"{prose(15)} {passage}" for _ in range(20)] + [LONG, edited(LONG, 0.005), "One  two\nthree", "ſ k"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs(spark, rows)).collect()}
    assert got == plain_groups(rows)
    assert jaccard.groups(docs(spark, [])).count() == 0
    again = jaccard.groups(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (None, "n"), (3, "A B c d e f")]))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in again.collect()) == [("1", 2, "1"), ("1", 2, "1"), ("2", 1, "2"), ("3", 2, "1"), ("None", 1, "None")]


def test_jaccard_groups_of_a_shingle_that_many_have(spark, monkeypatch):
    """Pairs that no hub finds, among documents that all share some shingles, in blocks of a few documents."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    head, texts = prose(12), []
    for _ in range(14):
        base = f"{head} {prose(30)}"
        texts += [base, base + " " + prose(6), prose(3) + " " + base]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs(spark, rows)).collect()}
    assert got == plain_groups(rows)


def test_prefixes_of_every_length_share_enough():
    """The theorem that the join stands on, with the sizes' own overlap, for random sets and orders."""
    for _ in range(300):
        n = rng.randint(1, 40)
        x = set(rng.sample(range(60), n))
        y = set(itertools.islice((v for v in [*rng.sample(sorted(x), n), *range(100, 200)]), max(1, int(n * rng.uniform(0.75, 1.3)))))
        same = len(x & y)
        if 100 * same < 75 * len(x | y):
            continue
        least = -(-75 * (len(x) + len(y)) // 175)
        for level in range(1, min(jaccard.MATCHES, same) + 1):
            assert len(set(sorted(x)[: len(x) - least + level]) & set(sorted(y)[: len(y) - least + level])) >= level


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(1)
    for n in (1, 3, 20, 300, 5000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[: int(n * 0.88) + 1], r.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
        same = len(np.intersect1d(x, y))
        if 100 * same >= 75 * (len(x) + len(y) - same):
            assert jaccard.possible(jaccard.sketch(x), jaccard.sketch(y), 75)
    assert not jaccard.possible(jaccard.sketch(r.integers(0, 1 << 63, 1000, dtype=np.uint64)), jaccard.sketch(r.integers(0, 1 << 63, 1000, dtype=np.uint64)), 75)


def test_decontaminate(spark):
    items = [(1, prose(30)), (2, prose(12)), (3, prose(30)), (4, None), (5, " "), (6, "Short one")]
    k = decontaminate.edits(len(decontaminate.fold(items[2][1])))
    near, far = list(items[2][1]), list(items[2][1])
    for j in range(k):
        near[3 + 7 * j % len(near)] = "#"
    far[::6] = ["@"] * len(far[::6])
    texts = [*EDGES, f"{prose(9)}\n {items[0][1].upper()}\t{prose(9)}", items[1][1].replace(" ", "\n  "), "".join(near), "".join(far), LONG + " " + items[0][1], prose(50), "a SHORT  one here"]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs(spark, texts), table, slice_chars=100).collect()}
    want = plain_matches(list(enumerate(texts)), items)
    assert found == {key: d for key, (d, _) in want.items()} and set(found) == {(6, 1), (7, 2), (8, 3), (10, 1), (12, 6)} and 0 < found[8, 3] <= k
    kept = decontaminate.clean(docs(spark, texts), table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 9, 11] and kept.columns == docs(spark, []).columns
    assert decontaminate.matches(docs(spark, texts), table.limit(0)).count() == 0 and decontaminate.clean(docs(spark, []), table).count() == 0


def plain_distance(p, t):
    """(least edit distance of p to any part of t, the first end of such a part), by the whole table, row by row."""
    row = np.zeros(len(t) + 1, dtype=np.int64)
    letters, steps = np.array([ord(c) for c in t], dtype=np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(p, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (letters != ord(c)))))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def plain_matches(rows, items):
    """{(doc, item): (edits, end)} of all items within their budget of any part of a text: each compared with each."""
    out = {}
    for doc, text in rows:
        t = decontaminate.fold(text or "")
        for item, pattern in items:
            p = decontaminate.fold(pattern or "")
            if p and t:
                d, end = (0, t.index(p) + len(p)) if p in t else plain_distance(p, t)
                if d <= decontaminate.edits(len(p)):
                    out[doc, item] = (d, end)
    return out


def spoiled(text, n, letters="abcdefgh "):
    """A text with n random letters changed, put in or left out."""
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], [rng.choice(letters)], [t[i], rng.choice(letters)]])
    return "".join(t)


def test_decontaminate_against_all_pairs(spark):
    items = [(i, prose(rng.randint(4, 40))) for i in range(12)]
    texts = [f"{prose(rng.randint(0, 20))} {spoiled(t, e)} {prose(rng.randint(0, 20))}" for _, t in items for e in (0, 1, 2, 4, 8, 14)]
    texts += [f"{spoiled(items[0][1], 3)} {spoiled(items[0][1], 1)} {items[1][1][:-9]}", prose(400)]
    rows = [(None if i == 3 else i // 2 * 2, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain_matches(list(enumerate(texts)), items)
    assert 30 < len(want) < len(texts) * 2
    for chars in (100, 1 << 20):
        found = {(r["doc_id"], r["item_id"]): (r["edits"], r["end"]) for r in decontaminate.matches(docs(spark, list(enumerate(texts))), table, slice_chars=chars).collect()}
        assert found == want
    # rows are judged by their own texts, whether their ids repeat or are null
    got = sorted((str(r["doc_id"]), r["contaminated"], r["item_ids"], r["least_edits"]) for r in decontaminate.report(docs(spark, rows), table).collect())
    of = [sorted((item, d) for (doc, item), (d, _) in want.items() if doc == i) for i in range(len(texts))]
    assert got == sorted((str(i), bool(f), [x for x, _ in f], min((d for _, d in f), default=None)) for (i, _), f in zip(rows, of, strict=True))


def test_myers_against_the_plain_table():
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (70, 90))
        assert decontaminate.myers(p, t, len(p)) == plain_distance(p, t) or plain_distance(p, t)[0] == len(p)


def test_mixture(spark):
    rows = docs(spark, [(i % 900, prose(3)) for i in range(1000)] + [(None, None)])
    got = mixture.mix(rows, {"s0": 3.0, "s1": 1.0}, size=2.0).collect()
    by = {s: sum(r["source"] == s for r in got) for s in ("s0", "s1")}
    assert abs(by["s0"] - 1500) < 250 and abs(by["s1"] - 500) < 140 and set(r["source"] for r in got) == {"s0", "s1"}
    table = {r["source_key"]: r["rate"] for r in mixture.rates(rows, {"s0": 3.0, "s1": 1.0}, size=2.0).collect()}
    for r in got[:200]:
        u = int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        assert r["n_copies"] == plain_poisson(table[r["source"]], u) and r["copy_ix"] < r["n_copies"]
    assert sorted(map(str, got)) == sorted(map(str, mixture.mix(rows.repartition(3), {"s0": 3.0, "s1": 1.0}, size=2.0).collect()))
    assert mixture.mix(docs(spark, [])).count() == 0
    lost = mixture.mix(docs(spark, [(None, f"t{i}") for i in range(400)]).withColumn("source", F.lit("x"))).collect()
    assert len({r["shuffle_key"] for r in lost}) == len(lost) and 300 < len(lost) < 500


def plain_poisson(mean, u):
    """The least count whose distribution function is above u, by adding up terms from 0."""
    term, total, k = math.exp(-mean), 0.0, 0
    while (total := total + term) <= u and k < 10 * mean + 100:
        k += 1
        term *= mean / k
    return k


def test_poisson_counts_against_plain_sums():
    for mean in (0.05, 0.3, 1.0, 4.0, 90.0, 600.0):
        u = np.array([rng.random() for _ in range(300)] + [0.0, 1 - 2**-48])
        got = mixture.counts(np.full(len(u), mean), u)
        assert got[:300].tolist() == [plain_poisson(mean, x) for x in u[:300].tolist()] and got[300] == (0 if mean < 600 else got[300])
        assert abs(got[:300].mean() - mean) < 6 * math.sqrt(mean / 300)
    many = mixture.counts(np.full(20_000, 1e6), np.random.default_rng(1).random(20_000))
    assert abs(many.mean() - 1e6) < 50 and abs(many.std() - 1e3) < 30 and len(mixture.poisson_steps(1e6)[1]) < 25_000
    assert mixture.counts(np.array([0.0, -1.0, np.inf]), np.array([0.5, 0.5, 0.5])).tolist() == [0, 0, 0]


def test_sources_too_many_to_broadcast(spark, monkeypatch):
    rows = docs(spark, [(i, prose(3)) for i in range(300)])
    want = sorted(map(str, mixture.mix(rows).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", -1)
    assert sorted(map(str, mixture.mix(rows).collect())) == want


def labelled(spark, n=600):
    insults = ["gruk", "snib", "zagloi"]
    texts = [prose(40) + (" " + rng.choice(insults) + " and " + rng.choice(insults) if i % 5 == 0 else "") for i in range(n)]
    return docs(spark, texts), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(n)] + [(0, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    d, labels = labelled(spark)
    lexicon = toxicity.fit(d, labels)
    got = toxicity.classify(d, lexicon).join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got) and sum(r["predicted"] == r["toxic"] for r in held) >= 0.98 * len(held)
    tricks = [*EDGES, "you are an іdі0t and a ｌｏｓｅｒ", "put it in the trash can", "you are trash and scum", "Trashy scummy words", "w0rthless m0r0n"]
    seen = {r["doc_id"]: (r["hits"], r["score"]) for r in toxicity.classify(docs(spark, tricks), toxicity.Lexicon({toxicity.fold(w): 4.0 for w in toxicity.SEED})).collect()}
    assert [seen[i][0] for i in range(len(tricks))] == [0] * 6 + [2, 0, 2, 0, 2] and len({seen[i][1] for i in range(6)}) == 1
    kept = toxicity.clean(d, lexicon)
    assert kept.columns == d.columns and 470 <= kept.count() <= 490
    assert toxicity.fit(d, labels.limit(0)).weights and toxicity.classify(docs(spark, []), lexicon).count() == 0


def plain_toxicity(text, lexicon):
    """(hits, score): every entry is looked for at every place of the folded text."""
    t = toxicity.fold(text or "")
    letter = lambda i: 0 <= i < len(t) and t[i].isalnum()
    stands = lambda e, i: t.startswith(e, i) and not letter(i - 1)
    harmless = [(i, i + len(x)) for x in lexicon.exceptions for i in range(len(t)) if stands(x, i) and not letter(i + len(x))]
    hits = []
    for i in range(len(t)):
        best, end = 0.0, i
        for e, w in lexicon.weights.items():
            word = e.rstrip("*")
            if stands(word, i) and (e.endswith("*") or not letter(i + len(word))) and (w, len(word)) > (best, end - i):
                best, end = w, i + len(word)
        if best and not any(a <= i and end <= b for a, b in harmless):
            hits.append(best)
    b0, b1, b2 = lexicon.logistic
    z = b0 + b1 * math.log1p(sum(hits)) + b2 * sum(hits) / math.sqrt(t.count(" ") + t.count("\n") + 1)
    return len(hits), 1 / (1 + math.exp(-z))


def test_toxicity_against_every_entry_at_every_place(spark):
    words = [toxicity.fold(w) for w in toxicity.SEED]
    lexicon = toxicity.Lexicon({w: 1.0 + i / 10 for i, w in enumerate(words)} | {w[:5] + "*": 2.0 for w in words[:8] if len(w) > 5})
    marks = ["trash", "trash can", "Tr4sh", "m0r0n", "clown nose", "clowns", "idiots", "ｉｄｉｏｔ", "pond scum", "scum", "st*pid", "stupidly", "a$$hole", "!diot", "bas-tard", "lоser", "xidiot", "IDIOT"]
    texts = [*EDGES[:5], *(" ".join(rng.choice([prose(1), rng.choice(marks)]) + rng.choice(["", ".", "!", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(60)), LONG[:3000] + " idiot"]
    got = {r["doc_id"]: r for r in toxicity.classify(docs(spark, texts), lexicon).collect()}
    seen = 0
    for i, t in enumerate(texts):
        hits, score = plain_toxicity(t, lexicon)
        seen += hits
        assert got[i]["hits"] == hits and abs(got[i]["score"] - score) < 1e-12 and got[i]["predicted"] == int(score >= 0.7), t
    assert seen > 200
    kept = {r["doc_id"] for r in toxicity.clean(docs(spark, texts), lexicon).collect()}
    assert kept == {i for i, r in got.items() if r["score"] < toxicity.THRESHOLD}


def test_site_quality(spark):
    good, bad = (lambda: prose(60)), (lambda: " ".join(["Zu!!"] * 30) + " ### ###")
    d = docs(spark, [bad() if i % 4 == 0 else good() for i in range(400)] + EDGES[:3])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)] + [(401, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(i, f"https://h{i % 3}.example.org/en/{i}?q=1#t", "") for i in range(0, 300, 3)] + [(900, None, None), (901, "http://x", "")], "page_id long, url string, html string")
    out = quality.combine(quality.evidence(d, quality.fit(d, labels)), quality.sites(d, pages)).cache()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 403 and all(rows[i]["keep"] == (i % 4 != 0) for i in range(400)) and rows[3]["path"] == "h0.example.org/en" and rows[1]["host"] == "s1"
    mean = sum(r["evidence"] for r in rows.values()) / 403
    assert all(min(mean, 0) <= r["path_rate"] <= 1 for r in rows.values())
    none = quality.fit(d, labels.limit(0))
    assert all(abs(r["evidence"] - 0.5) < 1e-12 for r in quality.evidence(d, none).collect()) and quality.evidence(docs(spark, []), none).count() == 0


def test_sites_too_many_to_broadcast(spark, monkeypatch):
    d = docs(spark, [prose(30) for _ in range(90)])
    pages = spark.createDataFrame([(i, f"https://h{i % 7}.org/p{i % 3}/{i % 60}", "") for i in range(120)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = lambda: sorted((r["doc_id"], r["path"], round(r["score"], 9)) for r in quality.combine(quality.evidence(d, quality.fit(d, labels)), quality.sites(d, pages)).collect())
    want = rows()
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    assert rows() == want and len(want) == 90
    assert quality.fit(d, labels, among=F.col("doc_id") < 0).weights.any() == False  # noqa: E712  no labels are left


def test_every_page_of_a_document_counts(spark):
    shows = {1: [("a", "x"), ("b", "x")], 2: [("a", "x"), ("a", "y"), ("a", "x")], 3: [("b", "x")], 4: [("b", "z")], 5: [], 6: [("a", "y"), ("b", "z")]}
    p = {1: 0.9, 2: 0.8, 3: 0.1, 4: 0.2, 5: 0.6, 6: 0.5}
    d = docs(spark, [(i, "t") for i in shows])
    pages = spark.createDataFrame([(k, f"http://{h}/{s}/{i}", "") for i, at in shows.items() for k, (h, s) in enumerate(at)], "page_id long, url string, html string")
    evidence = spark.createDataFrame([*p.items(), (3, p[3])], "doc_id long, evidence double")  # document 3 stands twice
    got = quality.combine(evidence, quality.sites(d, pages)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3, 4, 5, 6] and len(quality.sites(d, pages).collect()) == 9

    sites = {i: {(h, f"{h}/{s}") for h, s in at} or {("s1", "s1/en")} for i, at in shows.items()}
    paths, hosts, every = {}, {}, [*p.items(), (3, p[3])]
    for i, e in every:
        for s in sites[i]:
            paths.setdefault(s, []).append(e)
        for h in {h for h, _ in sites[i]}:
            hosts.setdefault(h, []).append(e)

    def strength(groups):
        n, s, k = sum(map(len, groups)), sum(map(sum, groups)), len(groups)
        m, q, n2 = s / n, sum(sum(g) ** 2 / len(g) for g in groups), sum(len(g) ** 2 for g in groups)
        spread = (q - n * m * m - (k - 1) * m * (1 - m)) / (n - n2 / n)
        return min(max(m * (1 - m) / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0

    a, b, prior = strength(list(hosts.values())), strength(list(paths.values())), sum(e for _, e in every) / len(every)
    odds = lambda x: np.log(x / (1 - x))
    for r in got:
        e, rates = p[r["doc_id"]], []
        for s in sites[r["doc_id"]]:
            host = (sum(hosts[s[0]]) - e + a * prior) / (len(hosts[s[0]]) - 1 + a)
            rates.append((sum(paths[s]) - e + b * host) / (len(paths[s]) - 1 + b))
        want = odds(e) + np.mean([odds(x) for x in rates]) - odds(prior)
        assert abs(r["score"] - 1 / (1 + np.exp(-want))) < 1e-9 and (r["host"], r["path"]) == min(sites[r["doc_id"]])


def test_licenses(spark):
    texts = [*EDGES, "Released Under the MIT-License. under the mit license", "Apache License, Version 2.0; CC BY-NC", "Licnsed under the Apache Licence Version 2.0", "Redistribution and use in source and binary form, with or without modificatons, are permited", "ＣＣ by nc", LONG + " cc-by_nc cc by nc"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(licenses.LOWER))
        at = sorted(k for p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
    assert [got[i]["labels"] for i in (6, 7, 8, 9)] == [["mit"], ["apache-2", "cc-by-nc"], ["apache-2"], ["bsd"]] and got[8]["base_labels"] == [] and 0 < got[8]["score"] < 1 == got[6]["score"]
    assert all(got[i]["score"] == 0 and got[i]["labels"] == [] for i in range(6)) and licenses.scan(docs(spark, [])).count() == 0


def test_kindred_licenses_are_told_apart(spark):
    texts = ["Licensed under CC BY-ND 4.0", "Licensed under CC BY-NC-SA 4.0", "licensd under CC BY-NC 4.0", "Licensed under CC BY 4.0", "under the terms of the GNU Lesser General Public License", "under the terms of the GNU Genral Public License",
             "under the bit license", "Licensed under the Apache License, Version 1.1", "under the terms of the GNU Affero General Public Licence"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(9)] == [["cc-by-nd"], ["cc-by-nc", "cc-by-nc-sa"], ["cc-by-nc"], ["cc-by"], ["lgpl"], [], [], [], ["agpl"]]


def test_notices_against_all_alignments():
    """A notice is found where the whole table of distances finds it within its budget, and only there."""
    plain = {t: label for t, label in licenses.NOTICES.items() if not licenses.EXACT.get(t)} | {prose(k): f"l{k}" for k in (2, 4, 7, 11)}
    find, seen = licenses.Notices(plain), 0
    for _ in range(150):
        some = [spoiled(rng.choice(list(plain)), rng.randint(0, 9)) for _ in range(rng.randint(1, 3))]
        words = licenses.fold(" ".join(f"{prose(rng.randint(0, 6))} {x}" for x in some))
        want = {label for text, label in plain.items() if plain_distance(text, words)[0] <= max(0, min(len(text) // 12, len(text) // 7 - 1))}
        found = find.found(words)
        assert {x[0] for x in found} == want
        assert all(plain_distance(next(t for t, n in plain.items() if n == x[0] and len(t) == x[4]), words[x[1] : x[2]])[0] <= x[3] for x in found)
        kept = find(words)
        assert all(a[2] <= b[1] for a, b in itertools.pairwise(kept)) and all(any(x[1] < k[2] and k[1] < x[2] for k in kept) for x in found)
        seen += len(found)
    assert seen > 100


def test_edited_notices_before_a_better_one():
    find = licenses.Notices({"under the mit license": "mit"})
    edited, exact = "under the mit licence", "under the mit license"
    for parts in ([edited, exact], [edited, edited, exact, edited], [exact, edited]):
        got = find(" ".join(parts))
        assert [x[3] for x in got] == [int(p == edited) for p in parts]
        assert all(abs(x[1] - 22 * i) <= 1 and abs(x[2] - (22 * i + 21)) <= 1 for i, x in enumerate(got))


def test_secrets(spark):
    key = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(40))
    texts = [*EDGES, f"é PassWord = 'hunter2' then {key} ſecret=abcdef1", "secret: token: abc password=abcdefg", "AKIA" + "B7" * 8 + " AKIAXY " + "0a" * 12, "d41d8cd98f00b204e9800998ecf8427e", "6513270e-269e-0d37-f2a7-4de452e6b438", "snake_case_identifier_of_many_words_12", LONG + " api_key=zzzzzz", "\x1f API-KEY: no apiKEY:'yes-yes'"]
    import public_tokenizers

    found = secrets.scan(docs(spark, texts), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in secrets.digest(found).collect()}
    for i, t in enumerate(texts):
        t, base = t or "", []
        base += [("assign", m.start(), m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda x: (x[1], secrets.KINDS.index(x[0]))))
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (*(sum(b[0] == k for b in base) for k in secrets.KINDS[:3]), hashlib.sha256(text.encode()).hexdigest())
        assert [s for s in r["spans"].split(",") if s and not s.startswith("token")] == [s for s in text.split(",") if s]
    at = texts[6].index(key)
    assert f"token:{at}:{at + 40}" in got[6]["spans"] and "token" not in got[10]["spans"] + got[11]["spans"] and secrets.scan(docs(spark, []), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_token_spans_against_a_plain_scan(spark):
    """Every run of candidate characters of a text is tested, with no look for long runs before."""
    import public_tokenizers

    test = secrets.TokenTest(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, secrets.RATIO)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    odd = ["password=" + key(24), "AKIA" + "Q7" * 9, "0a" * 14, key(30) + "==", "-" + key(22) + "-", "é" + key(20), key(19), "snake_case_of_many_words_and_more", "2024-01-01-2024-01-01-99", "a/b/" + key(26)]
    texts = [*EDGES, *(" ".join(rng.choice([prose(2), key(rng.randint(10, 44)), rng.choice(odd)]) for _ in range(12)) for _ in range(50))]
    got = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} for r in secrets.scan(docs(spark, texts), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    found = 0
    for i, t in enumerate(texts):
        t = t or ""
        base = {(k, *m.span()) for k, p, g, least in (("assign", secrets.ASSIGN, 2, 6), ("access", secrets.ACCESS, 0, 20), ("hex", secrets.HEX, 0, 24)) for m in p.finditer(t) if len(m[g]) >= least}
        want, at = set(), 0
        while at < len(t):
            end = at
            while end < len(t) and (t[end].isascii() and t[end].isalnum() or t[end] in "+/_=-"):
                end += 1
            a, b = at, end
            if end - at >= 20:
                a += len(t[a:b]) - len(t[a:b].lstrip("=-_/+"))
                b -= len(t[a:b]) - len(t[a:b].rstrip("-_/+"))
                if not any(x < b and a < y for _, x, y in base) and test(t[a:b]):
                    want.add(("token", a, b))
            at = max(end, at + 1)
        assert got[i] == base | want
        found += len(want)
    assert found > 100


def test_random_keys_are_found_and_words_are_not():
    import public_tokenizers

    test = secrets.TokenTest(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, secrets.RATIO)
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for n, least in ((20, 0.97), (32, 0.99), (40, 0.99)):
        assert sum(test("".join(r.choice(letters) for _ in range(n))) for _ in range(400)) >= least * 400
    words = ["configuration", "benchmark", "the", "document", "value", "token", "shard", "partition", "next", "result"]
    names = ["_".join(r.choice(words) for _ in range(4)) for _ in range(200)] + ["".join(r.choice(words).title() for _ in range(4)) for _ in range(200)]
    assert not any(map(test, names))


def test_secrets_without_digits():
    import public_tokenizers

    test = secrets.TokenTest(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, secrets.RATIO)
    r = random.Random(8)
    keys = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n)) for n in (20, 24, 32, 40)]
    assert all(map(test, keys)) and test(f"{keys[0]}-{keys[1]}")
    words = ["xkqzvwjyhgbtrpdlmnfc", "XKQZVWJYHGBTRPDLMNFC", "Xkqzvwjyhgbtrpdlmnfc", "12345678901234567890", "getTheNextElementOfTheList", "snake_case_identifier_of_many_words_12", "d41d8cd98f00b204e9800998ecf8427e"]
    assert not any(map(test, words))


def test_warc_round_trip(spark):
    big = "<p>" + prose(300)
    html = [(0, big), (1, big), (2, None), (3, ""), (4, "short"), (5, "short"), (6, big), (7, LONG * 3), (None, big + "x")]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://e.org/ä b/{i}", h, "z") for i, h in html], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.archive(pages).collect()}
    for i, h in html:
        raw = (h or "").encode()
        twin = i in (0, 1)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if twin else "response", 6 if twin else None)
        assert got[i]["payload"] is None if twin else bytes(got[i]["payload"]) == raw
    assert warc.archive(pages.limit(0)).count() == 0 and warc.archive(pages.where("page_id = 6").union(pages.where("page_id = 6"))).where("record_type = 'response'").count() == 2


def test_warc_record_of_many_chunks(spark):
    """Frames longer than what is read at once, beside short ones, and a file that ends within a record."""
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40_000))
    long = "".join(noise[k % 39_000 : k % 39_000 + 997] for k in range(0, 12_000_000, 3001))
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", long), (3, "u", "b")], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, warc.new_path(spark, "warc"))
    assert {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(manifest).collect()} == {1: 1, 2: len(long), 3: 1}
    path = warc.new_path(spark, "cut") + "/x.warc.zst"
    from tidemark.llm.common import read_file, write_file

    write_file(path, [read_file(manifest.first()["path"])[:-5]])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(path))


def test_warc_page_fetched_again(spark):
    one, two, three = ("<p>" + prose(300) for _ in range(3))
    html = [(1, one), (1, two), (1, three), (2, one), (3, three)]
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", h) for i, h in html], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect()), key=str)
    sha = lambda h: hashlib.sha1(h.encode()).hexdigest()
    assert got == sorted([(1, sha(one), "revisit", 2), (1, sha(two), "response", None), (1, sha(three), "revisit", 3), (2, sha(one), "response", None), (3, sha(three), "response", None)], key=str)


def test_embeddings(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((30, 16))
    vecs = [*base] + [b + r.normal(0, s, 16) for b in base[:12] for s in (0.02, 0.1, 0.15, 0.25)] + [base[0]] * 3
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vecs)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [], 0), (906, [1e300, -1e300], 0), (907, [1e-300, -1e-300], 0), (908, rows[2][1], 0)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "vec_id long, embedding array<double>, label int, key string")
    ok = {i: (np.array(e) / np.abs(e).max() / np.linalg.norm(np.array(e) / np.abs(e).max()), lab) for i, e, lab in rows if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    linked = {i: {j for j in ok if j != i and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and float(ok[i][0] @ ok[j][0]) >= 0.98} for i in ok}
    got = {x["vec_id"]: x for x in embeddings.links(df).collect()}
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = linked.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(linked.get(i, ())), min(reach), min(reach) == i)
    assert embeddings.links(df.limit(0)).count() == 0


def test_rows_that_repeat_a_vec_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.01, 1.0]
    rows = [(3, a), (5, a), (5, b), (5, b), (9, c), (7, c), (8, [0.0, 0.02, 1.0]), (6, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.links(df).collect())
    # vectors of id 5: one like that of 3, and one apart from it, twice; so 3 and 5 are one component
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (5, 1, 3, False), (6, 0, 6, True), (7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False)]


def test_hashes_do_not_depend_on_what_is_beside():
    r = np.random.default_rng(2)
    x = embeddings._units(r.standard_normal((700, 33)))
    whole = embeddings.hashes(x, 48, 12, 1.4)
    assert all((embeddings.hashes(x[k : k + n], 48, 12, 1.4) == whole[k : k + n]).all() for k, n in ((0, 1), (5, 2), (100, 77), (300, 400)))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    r = np.random.default_rng(6)
    v = r.standard_normal(8)
    df = spark.createDataFrame([(i, [float(x) for x in v + r.normal(0, 0.02, 8)], 1) for i in range(120)], "vec_id long, embedding array<double>, label int")
    x = np.array([r_["embedding"] for r_ in df.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.98).sum(1) - 1
    assert [r_["n_links"] for r_ in embeddings.links(df).orderBy("vec_id").collect()] == n.tolist()


def test_token_shards(spark):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = [*EDGES[:5], LONG[:40_000], "It's Don't, A. b.. É é ́x <|endoftext|>y \x85 z\r\n　日本 9,9.", *[prose(60) for _ in range(40)]]
    rows = [(i * 3 % 50, t) for i, t in enumerate(texts)] + [(0, "again"), (None, "nobody")]
    d = docs(spark, rows)
    manifest = tokens.write_shards(d, path, 2, tokens.new_path(spark, "t"), shard_tokens=500)
    starts = tokens.shard_starts(manifest)
    got = sorted(tokens.read_shards(starts).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows) and manifest.count() > 2
    want, at = {}, 0
    for i, t in rows:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == at and r["ids"] in want[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        want[r["doc_id"]].remove(r["ids"])
        at += len(r["ids"])
    assert [tuple(r)[:4] for r in got] == sorted((tuple(r) for r in tokens.digests(starts).collect()), key=lambda r: r[1])
    assert tokens.encode(docs(spark, []), path).count() == 0


def test_words_have_the_tokenizers_ids():
    """Words of all sorts of letters and signs, alone and together, twice, against the library itself."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    encoder, plain, r = tokens.WordEncoder(path), Tokenizer.from_file(path), random.Random(12)
    assert encoder.by_word and encoder.by_letters and encoder.lowers and encoder.parts
    letters = "abcdefgxyzABCXYZéÉñÑßœŒçøÅİıſŉªºµæÞðǅǆżŠ" + "дЖΣσςאع日ก" + "0123456789²½" + "e\u0301a\u0308" + "'’_-&!.,;:?*#@$%^()[]{}<>|/\\~`+=\"€™\u00ad\u200b\u00a0\u3000"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    words += ["".join(r.choice(letters[:38]) for _ in range(r.randint(1, 12))) + r.choice(["", ",", ".", "!!", "&&&", "'s", "'", "...", "?!", "-_-", "***,", "’s"]) for _ in range(4000)]
    words += ["<|endoftext|>", "x<|endoftext|>", "endoftext", "İstanbul", "ΟΔΟΣ", "don't.", "a.b", "ab'", "I'll,", "ﬁn", "Ａb", "ﷺ"]
    texts = [*words, *(" ".join(r.choice(words) for _ in range(30)) for _ in range(100))]
    for _ in range(2):
        ids, ends = encoder.encode(texts, 2)
        for t, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
            assert got.tolist() == plain.encode(t, add_special_tokens=False).ids + [2], t


@pytest.mark.parametrize("bits", [1, 5, 16, 17])
def test_wavelet_matrix(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 1 << bits, 1500).astype(np.uint32)
    _, _, wm = tokens.unpack_shard(tokens.pack_shard(np.array([1]), np.array([1500]), ids, bits))
    assert (wm.ids() == ids).all()
    for i in r.integers(0, 1500, 40).tolist():
        t = int(ids[i])
        where = np.flatnonzero(ids == t).tolist()
        assert wm.access(i) == t and wm.count(t) == len(where) and wm.rank(t, i) == sum(w < i for w in where)
        assert [wm.select(t, k) for k in range(min(3, len(where)))] == where[:3] and wm.select(t, len(where)) == -1
