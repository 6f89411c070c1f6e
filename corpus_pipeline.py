"""A training corpus from raw documents: each stage takes the documents that the one before kept.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and
reads again as the next one's docs. All but the last return the columns of the documents, whatever those are.

Cases: null and empty texts pass the first three stages (each is a document of its own); rows that share a doc_id are
judged each by its own text, but for near copies: there they are one document of several texts, which stays or goes as
a whole, and of its rows of equal text one stays; rows without a doc_id are documents by their text, so of equal ones
one stays; empty tables give an empty result; extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, mixture, tokens, toxicity
from tidemark.llm.common import discard, materialise
from tidemark.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents scored toxic; the lexicon is fitted on those at hand."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the least doc_id, once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a row without an id is known by its text, under a number above all usual ids
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))))
    named = docs.withColumn("_own", own)
    found = jaccard.groups(named.select(F.col("_own").alias("doc_id"), "text"), percent=75, words=5)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_own"))
    kept = named.join(others, "_own", "left_anti")
    again = materialise(named.groupBy("_own").agg(F.count("*").alias("k")).where("k > 1").select("_own"), "repeated-ids")
    if again.isEmpty():
        return kept.select(*docs.columns)
    twice = kept.join(again, "_own", "left_semi").withColumn("_text", F.sha2(text.cast("binary"), 256)).dropDuplicates(["_own", "_text"])
    return kept.join(again, "_own", "left_anti").select(*docs.columns).union(twice.select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources reach their target weights, shuffled globally."""
    return mixture.mix(docs, alpha=0.5, size=1.0, seed=17).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32 of each copy.

    Shards hold the documents as they stand in the files of docs, part by part, so a shuffle before them stays one;
    documents that come from no files go by doc_id.
    """
    try:
        place = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return tokens.encode(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    part = F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("int")
    return tokens.encode(place, vocabulary("word_bpe_49k.json"), end_id=2, order=[part, F.col("_file"), F.col("_row")])


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_leaks),
    ("source mixture", mix_sources),
    ("token shards", write_tokens),
]

#: Fitted weights, set joins down to components and a tokenizer have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents; what stages hand on is deleted as soon as it was read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the shards are written; the result reads those only
    return out
