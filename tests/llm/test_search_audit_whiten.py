"""Top-k search, source audit and whitening on small tables against plain versions, with the cases their docstrings name."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, topk, whiten
from tidemark.llm.vectors import runs

VECTORS = "vec_id long, embedding array<double>, row long, path string, dim int"
SCHEMA = "lang string, source string, text string, term string, n long, docs long"


def vectors(spark, rows):
    """Rows with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows], VECTORS)


def edges(rng, n=400, dim=6):
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # equal vectors
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[5][1])]  # repeated ids, none
    rows += [(2000, None), (2050, []), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2150, [math.nan] + [0.0] * (dim - 1)), (2200, [math.inf] + [1.0] * (dim - 1))]
    rows += [(2250, [1e300] * dim), (2300, [0.0] * dim), (2350, [-3.0, 2.5]), (2400, [1.0, 1.0]), (2401, [9.0, -1.0])]
    return rows


def plain_topk(rows, every, k, scale):
    good = [(r, i, [math.floor(scale * x) for x in v]) for r, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and max(map(abs, v)) < 1e10]
    out = []
    for r, i, q in good:
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(q, v)), j is None, j, s) for s, j, v in good if s != r and len(v) == len(q)]
            best = sorted(found, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:k]
            out += [(i, n + 1, j, -score) for n, (score, _, j, _) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [1 << 20, 600])
def test_topk(spark, monkeypatch, cells):
    """One shard, and many in waves."""
    monkeypatch.setattr(topk, "SHARD_CELLS", cells)
    monkeypatch.setattr(topk, "SHARD_MOST", 100 if cells == 600 else 1 << 14)
    rows = edges(np.random.default_rng(5))
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5, scale=256)
    assert sorted(map(tuple, got.collect()), key=str) == plain_topk(rows, 50, 5, 256)


def test_topk_of_few_and_none(spark):
    few = topk.search(vectors(spark, [(0, [1.0, -1.0]), (50, [2.0, 0.5]), (51, [-1.0, -1.0])]), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, few.collect())) == [(0, 1, 50, 98304), (0, 2, 51, 0), (50, 1, 0, 98304), (50, 2, 51, -163840)]
    assert topk.search(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0


def test_shard_stops_only_on_proof():
    """Any bound that holds gives the same best; sparse, signed, one-sided and constant dimensions."""
    rng = np.random.default_rng(2)
    for trial in range(40):
        n, dim = int(rng.integers(1, 300)), int(rng.integers(1, 20))
        x = rng.integers(-300, 300, (n, dim)) if trial % 3 else rng.integers(0, 3, (n, dim)) * rng.integers(0, 500, dim)
        shard = topk.Shard.unpack(b"".join(topk.Shard(np.arange(n), rng.permutation(n), np.ones(n, dtype=bool), x.astype(np.int64)).pack()))
        q = rng.integers(-200, 200, dim) * (rng.random(dim) < 0.8)
        own, scores = int(rng.integers(0, n)), x @ q
        want = sorted((s for s in range(n) if s != own), key=lambda s: (-scores[s], shard.ids[s]))[:5]
        for least in (-np.inf, *(scores[want[-1:]] if len(want) == 5 else [])):
            places, got = shard.search(q, own, 5, least)
            assert places.tolist() == want and got.tolist() == scores[want].tolist()


def test_index_recall_is_whole(spark):
    """Every vector is in one shard."""
    known = topk.numbered(vectors(spark, edges(np.random.default_rng(1))), 256)
    shards = topk.index(known)
    held = [topk.Shard.unpack(topk.read_file(r["path"])) for r in shards.collect()]
    assert sorted(int(r) for s in held for r in s.rows) == sorted(r["row"] for r in known.collect())


def plain_audit(rows, least, top):
    rows = [(t or "", x or "", s or "") for t, x, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang, source, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, c in docs:
            if x == lang:
                count[s].update({t: n for t, n in c.items() if t in kept})
        both = sum(count.values(), Counter())

        def p(c, t):
            return 1 + (10**9 * (c[t] + 2)) // (c.total() + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in count.items():
            pairs = [(sum(f(p(c, t), p(o, t)) for t in kept), i) for i, o in count.items() if i != s]
            terms = [(f(p(c, t), p(both, t)), t) for t in kept if c[t] and p(c, t) > p(both, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def audited_rows():
    rng = random.Random(4)
    words = ["alpha", "Beta", "été", "zz", "ZZ", "ﬀ", "日本", "ÀB", "o", "don't", "x1y", "😀"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(" ".join(rng.choices(words, weights=[1 + (k * (1 + s)) % 7 for k in range(len(words))], k=rng.randint(0, 40))), lang, f"s{s}") for lang in ("en", "de") for s in range(5) for _ in range(9)]
    rows += [(None, "en", "s0"), ("", None, None), ("alpha", None, "only"), ("123 !?", "fr", "é"), ("", "fr", "a"), ("x", "fr", "Z"), ("a\x00b " * 3_000, "en", "s1")]
    return rows + rows[:20]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    """Whole chunks, and chunks, matrices and bitmaps of very few terms with totals too large to broadcast."""
    if small:
        for name, value in (("CHUNK", 5), ("CELLS", 10), ("HELD", 8), ("BITS", 64), ("BROADCAST_BYTES", -1), ("PARTS", 3)):
            monkeypatch.setattr(divergence, name, value)
    rows = audited_rows()
    docs = spark.createDataFrame([(x, s, t, "a", 1, 2) for t, x, s in rows], SCHEMA).repartition(3)
    got = divergence.audit(docs, least_docs=4, top=3)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 4, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(300):
        whole = rng.randrange(2, 9 * 10**15)
        count = rng.randrange(0, whole - 1)
        assert divergence.p_of(np.array([count]), whole)[0] == 1 + 10**9 * (count + 2) // whole


def checked(got, rows, most=8):
    """Against numpy's eigenvectors, for the rows of one length."""
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    z = x - x.mean(axis=0)
    e, v = np.linalg.eigh(z.T @ z / len(z))
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    want = z @ v / np.sqrt(e)
    at = {}
    for r in got:
        at.setdefault(r["component"], []).append(r)
    deviation = {(i, int(d)) for (i, _), d in zip(rows, ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1))}
    for c in range(1, len(e) + 1):
        mine = np.array([r["whitened"] for r in sorted(at[c], key=lambda r: r["vec_id"])])
        assert min(np.abs(mine - want[:, c - 1]).max(), np.abs(mine + want[:, c - 1]).max()) < 1e-8
        assert {(r["vec_id"], int(r["deviation"])) for r in at[c]} == deviation
        assert all(abs(r["explained"] / (e[c - 1] / np.trace(np.cov(z.T, bias=True))) - 1) < 1e-9 and r["identity_error"] < 1e-9 and r["n"] == len(rows) for r in at[c])


def test_whiten(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2)
    monkeypatch.setattr(whiten, "BLOCK", 100)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13) + 5).tolist()) for i in range(500)]
    short = [(1000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(3000, None), (3001, []), (3002, [None] * 12), (3003, [math.nan] * 12), (3004, [1e300] * 12)]
    got = whiten.whiten(vectors(spark, rows + short + odd).repartition(7)).collect()
    assert len(got) == 500 * 8 + 40 * 3
    checked([r for r in got if r["vec_id"] < 1000], rows)
    checked([r for r in got if r["vec_id"] >= 1000], short)


def test_whiten_without_variance(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BROADCAST_BYTES", 8)  # one length a pass
    rows = [(i, [float(i % 2), 1.0, 2.0 * (i % 2)]) for i in range(6)] + [(7, [1.0]), (7, [1.0]), (None, [3.0, 4.0])]
    got = {(r["vec_id"], r["component"], r["n"]): r for r in whiten.whiten(vectors(spark, rows)).collect()}
    assert len(got) == 6 * 3 + 1 + 2  # the equal rows of id 7 are two, of one key
    assert abs(abs(got[0, 1, 6]["whitened"]) - 1) < 1e-9 and got[0, 2, 6]["whitened"] is None and got[0, 2, 6]["explained"] == 0
    assert got[0, 3, 6]["identity_error"] < 1e-9 and got[7, 1, 2]["identity_error"] is None and got[7, 1, 2]["whitened"] is None
    assert [(r["deviation"], r["n"]) for k, r in got.items() if k[0] is None] == [(0, 1), (0, 1)]
    assert whiten.whiten(vectors(spark, [])).count() == 0


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(v), -float(v), 1.0]) for i, v in enumerate((1 << 40, -(1 << 40), 5))]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in whiten.whiten(vectors(spark, rows)).collect()} == want


def test_runs_span_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1, 2], [], [2, 2], [2, 3], [None, None])]
    assert [(k, sum(p.num_rows for p in parts)) for (k,), parts in runs(iter(batches), "k")] == [(1, 2), (2, 4), (3, 1), (None, 2)]
