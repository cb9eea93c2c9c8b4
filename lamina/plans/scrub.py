"""Similarity dedup end to end: chunks -> sketches -> clusters -> parents -> deltas -> store."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..operators import cluster, report, store
from ..operators import sketch as sketching
from ..operators.codecs import codec
from ..sources.tables import stage


@dataclass(frozen=True)
class ScrubConfig:
    """sketch: gear or spectral; clusterer: equal, partial (gear only) or leader (spectral only)."""

    sketch: str = "gear"
    clusterer: str = "partial"
    codec: str = "gdelta"
    width: int = cluster.WIDTH
    mismatches: int = 6
    rate: int = sketching.RATE
    shrink_only: bool = False

    def __post_init__(self):
        codec(self.codec)
        if self.sketch not in ("gear", "spectral") or self.clusterer not in ("equal", "partial", "leader"):
            raise ValueError("unknown sketch or clusterer")
        if self.clusterer == "partial" and self.sketch != "gear":
            raise ValueError("partial clusters need the features of gear sketches")


@dataclass
class ScrubResult:
    store: DataFrame
    assigned: DataFrame
    seconds: dict = field(default_factory=dict)


def assign(chunks: DataFrame, config: ScrubConfig, known: DataFrame | None = None) -> DataFrame:
    """chunk_id, ord, cluster_key (string) of unique chunks (chunk_id, ord, data).

    Only ids, ords and sketches move, of which just what the clusterer needs: the data is sketched in a
    narrow map, with the ords beside it, and joined again for encoding alone. A gear sketch under the
    leader clusterer is its least feature.
    """
    made = sketching.sketches(chunks, config.sketch, config.rate, keep=("chunk_id", "ord"))
    if config.clusterer == "equal":
        return stage(cluster.equal_clusters(made, "sketch" if config.sketch == "spectral" else "super_features"), "equal")
    if config.clusterer == "partial":
        return cluster.partial_clusters(made, "super_features", config.mismatches)
    if config.sketch == "gear":
        made = made.withColumn("sketch", F.coalesce(F.array_min("features"), F.lit(2**32 - 1)))
    made = stage(made.select("chunk_id", "ord", "sketch"), "sketches")
    led = cluster.leader_clusters(made.select("chunk_id", "ord", "sketch"), config.width, known)
    return led.select("chunk_id", "ord", F.col("cluster_key").cast("string").alias("cluster_key"))


def scrub(chunks: DataFrame, config: ScrubConfig = ScrubConfig(), existing: DataFrame | None = None) -> ScrubResult:
    """Cluster and encode unique chunks (chunk_id, ord, data) that `existing` lacks. Phases are staged
    in the shared folder, so that each is timed, runs once and survives lost executors."""
    ship(chunks.sparkSession)
    seconds, t = {}, time.time()
    new = chunks if existing is None else store.new_chunks(chunks, existing)
    known = None
    if existing is not None and config.clusterer == "leader":
        known = existing.filter("role = 'leader'").select(F.col("cluster_key").cast("long").alias("leader"))
    assigned = stage(store.parents(assign(new, config, known), existing), "assigned")
    seconds["sketch_and_cluster"] = time.time() - t
    t = time.time()
    rows = stage(store.encode(assigned, chunks, config.codec, existing, config.shrink_only), "store")
    seconds["encode"] = time.time() - t
    return ScrubResult(rows, assigned, seconds)


def measure(streams: DataFrame, chunker, config: ScrubConfig = ScrubConfig()) -> DataFrame:
    """One row of ratios and times: chunk and dedup, scrub, restore and compare."""
    spark = streams.sparkSession
    ship(spark)
    t = time.time()
    chunks = stage(chunker(streams), "chunks").withColumn("chunk_id", F.col("sha256"))
    unique = stage(store.unique_chunks(chunks), "unique")
    sizes = report.dedup_bytes(chunks).first()
    cdc = time.time() - t
    t = time.time()
    made = scrub(unique, config)
    took = time.time() - t
    logical, once = sizes["logical_bytes"] or 0, sizes["unique_bytes"] or 0
    ratios = report.scrub_report(made.store, logical, once).first()
    t = time.time()
    back = store.restore(store.manifest(chunks, made.store), made.store)
    lost = streams.filter(F.octet_length("data") > 0).join(back.withColumnRenamed("data", "got"), "stream_id", "left").filter(~F.col("data").eqNullSafe(F.col("got"))).count()
    if lost:
        raise AssertionError(f"{lost} streams differ after restore")
    read = time.time() - t
    row = (ratios["cdc_ratio"] or 0, ratios["total_ratio"] or 0, 1000 * cdc, 1000 * took, 1000 * read)
    return spark.createDataFrame([tuple(map(float, row))], "cdc_dedup_ratio double, total_dedup_ratio double, cdc_time_ms double, scrub_time_ms double, restore_time_ms double")
