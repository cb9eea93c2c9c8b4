"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import ship

from .common import documents
from .lines import LINE_DEDUP_SQL, dedup_lines
from .mixing import MIX_SQL, mixed_documents
from .neardup import near_duplicates
from .packing import pack
from .pii import replace_pii
from .quality import quality_rules
from .sharding import shard_by_bytes
from .substrings import repeated_spans
from .topk import top_k
from .urls import URL_SQL, url_filter


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: the labels whose id is a page's; bad is low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))).select("page_id", "host", "path", "rule", "verdict")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return replace_pii(documents(spark, sf_dir)).select("doc_id", "n_entities", "text")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repeated_spans(documents(spark, sf_dir)).select("doc_id", "start", "length", "n_chunks", "first_doc_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), 24)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_packing, op2_mixing, op3_quality, op4_urls, op5_neardup, op6_pii, op7_topk, op8_substrings, op9_sharding, op10_lines)
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict:
    return {"op2_mixing": MIX_SQL, "op4_urls": URL_SQL, "op7_topk": TOPK_SQL, "op10_lines": LINE_DEDUP_SQL}
