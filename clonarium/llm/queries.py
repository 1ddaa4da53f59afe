"""Registered queries of the corpus operators; each digests its operator's results over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clonarium.datasets import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clonarium.llm.ngram_join import similar_sets

    return similar_sets(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clonarium.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clonarium.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clonarium.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clonarium.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clonarium.llm.quality import assess

    return assess(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from clonarium.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).withColumn("digest", F.xxhash64("tokens")).drop("tokens")


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clonarium.llm.lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"), order=4)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clonarium.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clonarium.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END) AS s FROM words)),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
 edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 walk AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT edges.b, walk.r FROM walk JOIN edges ON walk.doc_id = edges.a),
 roots AS (SELECT doc_id, min(r) AS component_id FROM walk GROUP BY doc_id)
SELECT documents.doc_id, coalesce(sizes.n, 0) AS n_shingles, roots.component_id FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id JOIN roots ON roots.doc_id = documents.doc_id
"""

SQL["op3_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SQL["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
 g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM g
"""
