"""The registered queries of this subpackage: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, embeddings, jaccard, licenses, mixture, quality, secrets, tokens, topk, toxicity, warc, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(table(spark, sf_dir, "pages"), min_bytes=1000)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc_dictionary"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM g)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to
FROM w
"""


@query
def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their text and by the site of the page that they were taken from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    evidence = quality.evidence(docs, quality.fit(docs, labels))
    return quality.combine(evidence, quality.sites(docs, table(spark, sf_dir, "pages")))


@query
def op4_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources tempered by the square root of their sizes, about as many copies as documents."""
    return mixture.mix(table(spark, sf_dir, "documents"), alpha=0.5, size=1.0, seed=17).select("doc_id", "text", "lang", "source", "n_chars", "copy_ix", "n_copies", "shuffle_key")


ORACLES["op4_poisson_mixture"] = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (sqrt(CAST(n AS DOUBLE)) / sum(sqrt(CAST(n AS DOUBLE))) OVER ()) * sum(n) OVER () / n AS rate FROM n),
s AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
      FROM r, (SELECT unnest(range(0, 300)) AS k)),
u AS (SELECT d.*, CAST('0x' || substr(md5('17:' || d.doc_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM documents d),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (WHERE s.upto <= u.u) AS n_copies
      FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_ix AS INT) AS copy_ix, CAST(n_copies AS INT) AS n_copies,
       md5('17s:' || doc_id || ':' || copy_ix) AS shuffle_key
FROM (SELECT c.*, unnest(range(0, n_copies)) AS copy_ix FROM c)
"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what was found in it: contaminated, and the sorted ids of the items."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), percent=75, words=5)


@query
def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


@query
def op8_secret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secrets.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return secrets.digest(found)


@query
def op9_pstable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(table(spark, sf_dir, "embeddings"), cosine=0.98)


ORACLES["op9_pstable_links"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), s AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a AS node, a AS reach FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a
), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
n AS (SELECT a AS node, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id,
       coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.node = vec_id
"""


@query
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


@query
def op11_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op11_impact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


ORACLES["op12_source_divergence"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
n AS MATERIALIZED (SELECT row, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM n GROUP BY lang, term HAVING count(*) >= 10),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM n JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
all_n AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, source),
lang_c AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
lang_n AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang),
gp AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(a.total, 0) + 2 * v.v) AS p
       FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
       LEFT JOIN all_n a ON a.lang = g.lang AND a.source = g.source),
lp AS (SELECT k.lang, k.term, 1 + (1000000000 * (l.n + 2)) // (t.total + 2 * v.v) AS q
       FROM kept k JOIN v USING (lang) JOIN lang_c l ON l.lang = k.lang AND l.term = k.term JOIN lang_n t ON t.lang = k.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
          FROM gp JOIN lp ON gp.lang = lp.lang AND gp.term = lp.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten.whiten(table(spark, sf_dir, "embeddings"), most=8, scale=1024, shift=100_000)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
