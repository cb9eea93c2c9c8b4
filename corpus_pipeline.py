"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Stages take any table with the columns of `documents`; all but the last return just these, and other
columns, whatever their names, are dropped. An empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import ship
from lamina.llm.common import one_each, stage, text_hash
from lamina.llm.lines import dedup_lines
from lamina.llm.mixing import mix
from lamina.llm.packing import pack
from lamina.llm.quality import quality_rules
from lamina.llm.similar import similar_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go; a null id is judged by its text like any other; null
    languages and sources stay. Repeated rows share a verdict and all stay or all go. Texts of any
    length are judged whole. Without labels only the base rules count.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; those with no line left go.

    Null and empty texts are one empty line, which stays (as an empty text). Rows of a null id come
    last and lose what others own; rows of one id count as one document, so repeated rows all stay.
    n_chars is counted anew.
    """
    ship(spark)
    kept = dedup_lines(docs).withColumn("text", F.col("kept_text")).filter((F.col("n_lines") > F.col("n_dropped")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, which share 0.8 or more of their shingles of five
    words: the one of the smallest id.

    Null, empty and wordless texts are near-duplicates of each other. Ids that are null come after all
    others, and by the text's hash; of repeated rows (same id and text) one stays, with the null,
    language or source of any of them.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = stage(similar_documents(docs), "near-duplicates")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("x"))
    first = least.select(F.col("x.doc_id").alias("__id"), F.col("x.th").alias("__th"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__th"))
    return one_each(docs, found).join(first, same, "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, one row for each turn of a document; where the budget ends within a document,
    its text is cut after the word.

    Null, empty and wordless texts have no words to take and go. Null sources are one source, the
    last; null ids queue first in theirs. Of repeated rows (same id and text) each queues, and each
    one's turns come out. n_chars is counted anew.
    """
    docs = docs.select(*COLUMNS)
    turns = stage(mix(docs.withColumn("th", text_hash()), keep=("th",)).filter("words > 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "size", "words", "turn"), "turns")
    rows = turns.filter("turn = 0").select(F.col("__id").alias("doc_id"), F.col("__th").alias("th"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__th"))
    mixed = one_each(docs, rows).join(turns, same).withColumn("text", F.when(F.col("words") < F.col("size"), cut_words(F.col("text"), F.col("words"))).otherwise(F.col("text")))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def cut_words(text, n):
    """text up to the end of its n-th word."""
    upto = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(upto, 1, n.cast("int")), "")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, in the columns of `pack`.

    A null or empty text is the end id alone; null and repeated ids keep all their pieces; texts of
    any length are cut into as many as they need.
    """
    ship(spark)
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Likelihood ratios and fingerprints of hashed n-grams and a tokenizer's ids are not SQL's to
#: express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
