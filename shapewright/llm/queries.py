"""The queries of the training-data operators and, where SQL can say them, their oracles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.embeddings import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.decontaminate import matches

    return matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_key")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.langid import identify

    return identify(_read(spark, sf_dir, "documents")).drop("text_key")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.urls import judge

    return judge(_read(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.tokens import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.html import main_text

    return main_text(_read(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.sharding import shard

    return shard(_read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shapewright.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).drop("text_key", "component")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_best_fit_packing, op3_benchmark_decontamination, op4_language_id, op5_url_filters, op6_token_counts, op7_warc, op8_html_extraction, op9_sharding, op10_simhash_near_dedup, pipeline)}


OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS reached FROM v
  UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.reached),
comp AS (SELECT node, min(reached) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON v.vec_id = comp.node LEFT JOIN n ON n.a = v.vec_id
"""

OP5 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT page_id, max_by(h || p, length(h) * 10000 + length(p)) AS rule, max_by(verdict, length(h) * 10000 + length(p)) AS verdict
  FROM named JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT named.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN fit USING (page_id)
"""

OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d
"""

ORACLES = {"op1_embedding_near_dedup": OP1, "op5_url_filters": OP5, "op7_warc": OP7}


@functools.lru_cache(1)
def oracles() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
