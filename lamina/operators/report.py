"""Dedup ratios and scrub reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(chunks: DataFrame, id_col: str = "chunk_id", ord_col: str = "ord") -> DataFrame:
    return chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.min(ord_col).alias("first"))


def dedup_bytes(chunks: DataFrame, by: tuple = ()) -> DataFrame:
    """logical_bytes and unique_bytes (different chunks once), overall or by columns: two aggregates, the
    first by chunk, so that no set of digests is gathered."""
    each = chunks.groupBy(*by, "chunk_id").agg(F.sum(F.octet_length("data")).alias("all"), F.first(F.octet_length("data")).alias("one"))
    return each.groupBy(*by).agg(F.sum("all").cast("long").alias("logical_bytes"), F.sum("one").cast("long").alias("unique_bytes"))


def scrub_report(store: DataFrame, logical_bytes: int, unique_bytes: int) -> DataFrame:
    """One row: data_left (bytes of chunks in full), processed_data (bytes of deltas), target_bytes (of
    the chunks that those deltas stand for), literal_bytes (of all different chunks that came in),
    clusters, chunks; cdc_ratio and total_ratio: logical bytes over the unique and over the stored
    bytes, null without any."""
    size = F.octet_length("payload")
    s = store.agg(
        F.coalesce(F.sum(F.when(F.col("chunk_type") == "simple", size)), F.lit(0)).cast("long").alias("data_left"),
        F.coalesce(F.sum(F.when(F.col("chunk_type") == "delta", size)), F.lit(0)).cast("long").alias("processed_data"),
        F.count(F.when(F.col("role") == "leader", 1)).alias("clusters"), F.count(F.lit(1)).alias("chunks"),
    )
    s = s.withColumn("logical_bytes", F.lit(logical_bytes).cast("long")).withColumn("literal_bytes", F.lit(unique_bytes).cast("long"))
    s = s.withColumn("target_bytes", F.col("literal_bytes") - F.col("data_left"))
    ratio = lambda n: F.round(F.try_divide(F.col("logical_bytes"), n), 6)
    return s.withColumn("cdc_ratio", ratio(F.col("literal_bytes"))).withColumn("total_ratio", ratio(F.col("data_left") + F.col("processed_data")))
