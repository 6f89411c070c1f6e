"""Queries over documents' lines and pages' URLs: templates by masks that any regex engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks
from ..registry import query


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq from 1, line: the lines of each document, by the line splitter's rules."""
    from ..sources.lines import split_text

    return split_text(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text", ["doc_id"])


LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}', '<email>', 'g'), '\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b', '<ip>', 'g'), '\\b[0-9]+\\b', '<int>', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS template FROM l WHERE line <> ''),
c AS (SELECT template, count(*) AS n FROM t GROUP BY template)
"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = lines(spark, sf_dir).where("line <> ''").select(masks.simple(F.col("line")).alias("template"))
    return masked.groupBy("template").agg(F.count("*").alias("n"))


@query(LINES + "SELECT md5(template) AS template_md5, length(template) AS chars, n FROM c")
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates(spark, sf_dir).select(F.md5(F.col("template").cast("binary")).alias("template_md5"), F.length("template").cast("long").alias("chars"), "n")


@query(LINES + "SELECT count(*) AS templates, count(*) FILTER (WHERE n = 1) AS singletons, CAST(sum(n) AS BIGINT) AS lines, round(count(*) FILTER (WHERE n = 1)::DOUBLE / count(*), 2) AS share FROM c")
def template_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates(spark, sf_dir).agg(F.count("*").alias("templates"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum("n").alias("lines"), F.round(F.count_if(F.col("n") == 1).cast("double") / F.count("*"), 2).alias("share"))


@query(
    """WITH u AS (SELECT regexp_replace(url, '[?#].*$', '') AS url FROM pages),
t AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[0-9]+', '<int>', 'g') AS template FROM u)
SELECT host, template, count(*) AS n FROM t GROUP BY ALL"""
)
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(masks.url_template(F.col("url")).alias("u"))
    return p.groupBy("u.host", "u.template").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT props AS template FROM events UNION SELECT DISTINCT event_type || ' of ' || CAST(user_id % 20 AS VARCHAR) FROM events),
w AS (SELECT template, string_split(template, ' ') AS words FROM t), k AS (SELECT template, unnest(range(1, len(words) + 1)) AS pos, words FROM w),
c AS (SELECT list_aggregate(list_concat(list_concat(words[1:pos - 1], ['*']), words[pos + 1:]), 'string_agg', ' ') AS family, words[pos] AS word FROM k)
SELECT family, count(*) AS members FROM c GROUP BY family HAVING count(*) > 1"""
)
def template_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that differ in one word."""
    from ..operators.templates import families

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = e.select(F.col("props").alias("template")).union(e.select(F.concat_ws(" of ", "event_type", (F.col("user_id") % 20).cast("string"))))
    return families(t.distinct()).select("family", "members")


@query()
def normalized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document line's exact template, with its behavior id and count."""
    from ..functions.ids import behavior_ids
    from ..functions.normalize import template_of

    counted = lines(spark, sf_dir).where("line <> ''").groupBy(template_of(F.col("line")).alias("template")).agg(F.count("*").alias("n"))
    return counted.withColumn("behavior_id", behavior_ids(F.lit("log"), F.col("template")))


@query()
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold secrets or personal data, as they may be kept; each document numbers its own."""
    from ..functions.redact import redact

    rows = lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("run_id"), F.col("doc_id").alias("feed"), F.col("doc_id").cast("string").alias("stream"), "seq", "line")
    return redact(rows, "pii").where("evidence <> line").select(F.col("feed").alias("doc_id"), "seq", "evidence", "masked")
