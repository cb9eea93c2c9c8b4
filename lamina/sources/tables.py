"""Streams of bytes from tables and files, staged tables, CSV reports."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, data: the UTF-8 bytes of every document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.encode("text", "utf-8").alias("data"))


def page_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("stream_id"), F.encode("html", "utf-8").alias("data"))


def file_streams(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """stream_id (by path), path, data of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("stream_id"), "path", F.col("content").alias("data"))


def memory_streams(spark: SparkSession, *data: bytes) -> DataFrame:
    """stream_id (from 0), data of byte strings of this process."""
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "stream_id long, data binary")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may do without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lamina-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_made: list[tuple[SparkSession, str]] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder, a folder for each value of `by`, and read it back:
    lineage ends there, and a lost executor costs a read, not a recomputation."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)  # texts take some 60 % of what snappy leaves
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like `stage`, in as many buckets by `key` as a shuffle has partitions, so that joins on it don't
    move the rows again. df: dealt by `key` already, as after an aggregate by it."""
    spark = df.sparkSession
    path, own = table_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").bucketBy(n, key).option("path", path).saveAsTable(own)
    return spark.table(own)


def drop_tables() -> None:
    """Delete every table this process staged; their readers must be done."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; the shared folder's owner clears it
            return


atexit.register(drop_tables)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one CSV file with a header."""
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)
