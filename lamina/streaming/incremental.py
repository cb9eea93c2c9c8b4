"""A Structured Streaming sink that scrubs each micro-batch against the store so far."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store
from ..plans.scrub import ScrubConfig, scrub


def scrub_batch(path: str, config: ScrubConfig):
    """foreachBatch function: new chunks of the batch join the store at `path`.

    Exactly once: rows of a batch that ran before are known by their digests and are not added again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        chunks = store.unique_chunks(batch.withColumn("chunk_no", F.lit(0)) if "chunk_no" not in batch.columns else batch)
        try:
            existing = store.read(spark, path)
        except AnalysisException as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = None
        store.write(scrub(chunks, config, existing).store, path)

    return run


def start(streams: DataFrame, path: str, checkpoint: str, config: ScrubConfig = ScrubConfig()):
    """Start the stream (stream_id, data) -> store; processes what is available and stops."""
    return streams.writeStream.foreachBatch(scrub_batch(path, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
