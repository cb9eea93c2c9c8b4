"""Harmonic packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .tokens import TextIds

#: A piece may leave 1 / SLACK of the capacity empty in a bin of its class before it is cut.
SLACK = 64
#: Buckets of each class, least and most; between the two one for each BUCKET_ROWS documents.
BUCKETS, BUCKET_ROWS = (256, 4096), 1 << 14
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, bucket int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(1 << 16)
def cut(rest: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of `rest` < capacity tokens.

    Class k holds lengths in (capacity / (k + 1), capacity / k]: k of them fill a bin. A length close
    under capacity / k stays whole. Another gives off a piece of capacity / (k + 1), which fills its
    bins to the token, and goes on with what is left, less than capacity / (k * (k + 1)).
    """
    out = []
    while rest:
        k = capacity // rest
        if (capacity - k * rest) * SLACK <= capacity or rest == 1:
            out.append((rest, k))
            break
        whole = capacity // (k + 1)
        out.append((whole, k + 1))
        rest -= whole
    return tuple(out)


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, class) of a document of n tokens."""
    full = n // capacity
    for i in range(full):
        yield i * capacity, capacity, 1
    at = full * capacity
    for length, k in cut(n - at, capacity):
        yield at, length, k
        at += length


def _pieces(capacity: int, tokenizer: str, end_id: int, with_ids: bool, buckets: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        coder = TextIds.at(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for doc_id, bucket, text in zip(batch["doc_id"].to_pylist(), batch["bucket"].to_pylist(), batch["text"]):
                ids = coder.ids(text.as_py()) + end
                n = len(ids) // 4
                for start, length, k in pieces_of(n, capacity):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(part), n, k, (bucket + start) % buckets)
                    for col, x in zip(out, (*row, part) if with_ids else row):
                        col.append(x)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "bucket"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def _first_fit(capacity: int):
    """Few pieces, all classes' last bins: first fit by falling length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first", ignore_index=True)
        used, seq, off, first = [], [], [], 0
        for n in rows["length"]:
            i = first
            while i < len(used) and used[i] + n > capacity:
                i += 1
            if i == len(used):
                used.append(0)
            seq.append(i)
            off.append(used[i])
            used[i] += n
            while first < len(used) and used[first] >= capacity:
                first += 1
        rows["sequence_id"] = rows["full_bins"] + pd.Series(seq, index=rows.index, dtype="int64")
        rows["offset"] = pd.Series(off, index=rows.index, dtype="int64")
        return rows.drop(columns="full_bins")

    return run


def pack(df: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of every document of df in sequences of at most `capacity` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless), offset, class, and with_ids
    the piece's ids (binary, little-endian 32-bit).

    Each worker cuts its documents into pieces of the reciprocal-capacity classes (see `cut`) and
    numbers the pieces of its bucket of a class on its own; adding the pieces of the buckets before
    makes the number the class's, and bin and place follow by dividing by the class's fixed count.
    Only the last bin of a class is not full. Those pieces, at most sum(k - 1) over the classes and
    thus bounded by the capacity whatever the input, are placed by first fit.

    A null or empty text is the end id alone. Ids may be null or repeat; equal rows share out their
    places. An empty table gives no rows. Other columns are ignored.
    """
    if capacity < 2:
        raise ValueError("capacity must be at least 2")
    schema = PIECE + (", ids binary" if with_ids else "")
    buckets = max(BUCKETS[0], min(BUCKETS[1], df.count() // BUCKET_ROWS))
    own = F.xxhash64("doc_id", F.octet_length("text"))  # ids may be null or one; lengths part them
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(own, F.lit(buckets)).cast("int").alias("bucket"), "text")
    made = stage(rows.mapInArrow(_pieces(capacity, tokenizer or default_tokenizer(), end_id, with_ids, buckets), schema), "pieces")
    counts = made.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("class")).alias("of_class"))
    bins = counts.select("class", F.floor(F.col("of_class") / F.col("class")).alias("bins")).distinct()  # a row a class
    bins = bins.select("class", "bins", F.coalesce(F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_bin"), F.sum("bins").over(Window.partitionBy()).alias("full_bins"))
    counts = counts.join(F.broadcast(bins), "class")  # classes <= 2 * sqrt(capacity), 4096 buckets at most
    number = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = made.withColumn("rn", number).join(F.broadcast(counts), ["class", "bucket"]).withColumn("index", F.col("base") + F.col("rn"))
    placed = stage(placed.withColumn("bin", F.floor(F.col("index") / F.col("class"))), "placed")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"] + ["ids"] * with_ids
    in_bin = Window.partitionBy("sequence_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    full = placed.filter(F.col("bin") < F.col("bins")).withColumn("sequence_id", F.col("first_bin") + F.col("bin")).withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    few = placed.filter(F.col("bin") >= F.col("bins")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "full_bins", *["ids"] * with_ids)
    few = few.groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: _first_fit(capacity)(rows), schema.replace("bucket int", "sequence_id long, offset long"))
    return full.select(*cols).unionByName(few.select(*cols))
