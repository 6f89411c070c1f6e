"""The pipeline's stages on a small corpus, each against what a plain version keeps."""

import hashlib
import struct
import zlib

import corpus_pipeline
import pytest

from tidemark.llm import decontaminate, mixture, toxicity
from tidemark.llm.common import WRITTEN, release
from tidemark.llm.queries import ORACLES, QUERIES, vocabulary
from tests.llm.test_operators import DOCS, plain_groups, plain_matches, plain_poisson, plain_toxicity, prose, spoiled


def write(spark, folder, rows, items, labels):
    spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), "x", "y") for k, (i, t) in enumerate(rows)], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_run_against_a_plain_version(spark, tmp_path):
    """Ids, their order and the ids' checksums of what comes out, from the definitions of the stages."""
    from tokenizers import Tokenizer

    item, copy = prose(40), prose(60)
    texts = [prose(50) for _ in range(60)] + [copy, copy + " end", f"{prose(5)} {spoiled(item, 3)} {prose(5)}", "you idiot loser moron scum " + prose(5), None, "", None]
    rows = list(enumerate(texts))
    docs = write(spark, tmp_path, rows, [(1, item)], [(0, 1, 0)])
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(i, t) for i, t in rows if plain_toxicity(t, lexicon)[1] < toxicity.THRESHOLD]
    groups = plain_groups(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    leaks = {doc for doc, _ in plain_matches(kept, [(1, item)])}
    kept = [(i, t) for i, t in kept if i not in leaks]
    assert {i for i, _ in rows} - {i for i, _ in kept} == {61, 62, 63}
    sizes = {s: sum(i % 3 == s for i, _ in kept) for s in range(3)}
    root = sum(n**0.5 for n in sizes.values())
    copies = []
    for i, t in kept:
        u = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16) / 2**48
        rate = sizes[i % 3] ** 0.5 / root * len(kept) / sizes[i % 3]
        copies += [(hashlib.md5(f"17s:{i}:{k}".encode()).hexdigest(), i, t) for k in range(plain_poisson(rate, u))]
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    # the order is the mixture's: by partition, then by key within it
    mixed = corpus_pipeline.mix_sources(spark, docs.where(docs.doc_id.isin([i for i, _ in kept])), str(tmp_path))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixed.collect()] != sorted(r["doc_id"] for r in got)
    assert sorted(r["doc_id"] for r in got) == sorted(i for _, i, _ in copies)
    text_of, at = dict(kept), 0
    for r in got:
        ids = plain.encode(text_of[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = write(spark, tmp_path, [(i, prose(9)) for i in range(20)], [(1, prose(30))], [(0, 1, 0)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_rows_that_repeat(spark, tmp_path):
    one, two, three = prose(40), prose(40), prose(40)
    rows = [(1, one), (1, one), (2, one), (3, two), (3, three), (3, two), (4, three), (None, prose(30)), (None, one), (None, "lost"), (None, "lost"), (5, None), (5, None), (6, "")]
    docs = write(spark, tmp_path, rows, [(1, prose(30))], [(0, 1, 0)])
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect())
    # 2 copies 1, 4 copies a text of 3, and a row without an id copies 1
    assert got == sorted([("1", one), ("3", two), ("3", three), ("None", rows[7][1]), ("None", "lost"), ("5", ""), ("6", "")])


def test_empty_tables_and_texts_from_no_files(spark, tmp_path):
    docs = write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    got = corpus_pipeline.write_tokens(spark, some, str(tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2] and mixture.mix(docs).count() == decontaminate.clean(docs, some.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_written_tables_are_released(spark, tmp_path):
    from tidemark.llm.common import materialise

    t = materialise(spark.range(3), "some")
    assert t.tidemark_path in WRITTEN[spark.sparkContext.applicationId]
    release(spark)
    assert not WRITTEN[spark.sparkContext.applicationId]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(t.tidemark_path).count()


def test_every_dealt_operator_is_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)} | {"pipeline"} and set(ORACLES) <= set(QUERIES)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
