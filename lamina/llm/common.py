"""Shared pieces of the corpus operators: tables in the shared folder, words, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stage, table_path  # noqa: F401  the operators' own, from here

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Kept(dict):
    """What a worker keeps of one operator. Workers outlive operators, so the next one to begin clears
    what the last has kept."""

    _last: Kept | None = None

    def begin(self) -> None:
        if Kept._last is not self:
            if Kept._last is not None:
                Kept._last.clear()
            Kept._last = self


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Words as an array; empty for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_hash() -> Column:
    """Hash of the text; with the id it tells rows of repeated ids apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def one_each(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with its repeated rows (same id and text) once; rows: doc_id, th of df. Texts move only if
    there are such rows."""
    if rows.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count():
        return df.withColumn("__th", text_hash()).dropDuplicates(["doc_id", "__th"]).drop("__th")
    return df
