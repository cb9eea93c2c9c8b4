"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stage, table_path

SPACE = r" \t\n\u000B\u000C\r"


def line_key(line: str) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.expr(f"trim(BOTH '{SPACE}' FROM {line})"))


class LineRuns:
    """Sorted, bucketed runs (k1, k2, owner) in levels; a key is in one run only.

    `add` takes a batch's keys, anti-joins them with every run by merging (the runs are bucketed by
    the key, so only the batch moves) and writes what is new as a run of level 0. `fanout` runs of a
    level are compacted into one of the next, so a key is rewritten once a level and a batch meets
    at most (fanout - 1) * levels runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.made: list[str] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", table_path(self.spark, f"line-run-{level}")
        self.made.append(name)
        df.select("k1", "k2", "owner").write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0][0])
            for other, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self._write(merged, level + 1)
            for other, _ in old:
                self.spark.sql(f"DROP TABLE {other}")

    def add(self, keys: DataFrame) -> None:
        """keys: k1, k2, owner; one row a key."""
        for name, _ in self.runs():
            keys = keys.join(self.spark.table(name).hint("merge"), ["k1", "k2"], "left_anti")
        self._write(keys, 0)

    def owners(self) -> DataFrame:
        """All keys; read without the buckets, so that a join may split hot keys."""
        out = None
        for _, path in self.runs():
            run = self.spark.read.schema("k1 long, k2 long, owner long").parquet(path)
            out = run if out is None else out.unionByName(run)
        return out

    def close(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(text, gone):
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([None if t is None else one(t, g) for t, g in zip(texts, dropped)], dtype=object)


def dedup_lines(df: DataFrame, min_chars: int = 10, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """df's columns plus n_lines, n_dropped, kept_text.

    A line whose key has at least `min_chars` code points and is found in two documents or more
    stays in the document of the smallest id only; there all its lines stay. Documents come in
    `n_batches` batches of rising id, so the first batch that has a key owns it: each batch adds the
    keys that no run has, with the smallest id in the batch. Keys are compared by 128 bits of hash.

    Null or empty text: one empty line, kept. Rows with a null id come last and own nothing, so only
    keys that a document with an id owns leave them; repeated ids count as one document. An empty
    table gives no rows. Other columns pass through (n_lines, n_dropped and kept_text are replaced).
    """
    spark = df.sparkSession
    df = df.drop("n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col("text"), F.lit(""))
    bounds = df.agg(F.percentile_approx("doc_id", [k / n_batches for k in range(1, n_batches)]).alias("b")).first()["b"] if n_batches > 1 else []
    batch = F.when(F.col("doc_id").isNull(), n_batches - 1).otherwise(sum((F.when(F.col("doc_id") > b, 1).otherwise(0) for b in sorted(set(bounds or []))), F.lit(0)))
    lines = (
        df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .withColumn("key", line_key("line")).filter(F.char_length("key") >= min_chars)
        .select("doc_id", "th", "line_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), F.col("key")).alias("k2"), batch.alias("batch"))
    )
    lines = stage(lines, "lines", "batch")
    runs = LineRuns(spark, fanout)
    try:
        for b in range(n_batches):
            runs.add(lines.filter(F.col("batch") == b).groupBy("k1", "k2").agg(F.min("doc_id").alias("owner")))
        owned = lines.join(runs.owners(), ["k1", "k2"]).filter(F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("owner") < F.col("doc_id"))))
        gone = owned.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("line_no").alias("__gone"))
        gone = stage(gone, "lines-gone")
    finally:
        runs.close()
    has = F.col("__gone").isNotNull()
    return (
        df.withColumn("__h", F.xxhash64(text))
        .join(gone, (F.col("__h") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
        .withColumn("n_lines", F.size(F.split(text, "\n")).cast("long"))
        .withColumn("n_dropped", F.when(has, F.size("__gone")).otherwise(0).cast("long"))
        .withColumn("kept_text", F.when(has, F.pandas_udf(_without, "string")(F.when(has, text), F.col("__gone"))).otherwise(text))
        .drop("__h", "__id", "__th", "__gone")
    )


LINE_DEDUP_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
