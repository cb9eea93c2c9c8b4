"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage

#: Bytes that a boundary depends on.
WINDOW = 16
#: Share of the white-space bytes, and of other first bytes of characters, that end a chunk; the latter
#: where the LONG bytes before hold no white space, as in scripts that do without.
AT_SPACE, ELSEWHERE, IN_LONG, LONG = 1 / 4, 1 / 512, 1 / 12, 40
#: Bytes of a run of repeated chunks that count as a repeated passage.
MIN_BYTES = 100
#: Bytes hashed at once.
SLICE = 1 << 20

_GEAR = np.frombuffer(b"".join(xxhash.xxh32_digest(bytes([b]), 7) for b in range(256)), dtype=">u4").astype(np.uint32)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FIRST = (np.arange(256) & 0xC0) != 0x80


def gear(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Gear hash of the `window` bytes that end at each place, by doubling: the hash of 2w bytes is
    that of the last w plus that of the w before, shifted by w."""
    h, w = _GEAR[data], 1
    while w < window:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    return h


def ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text's bytes, the last included. A boundary follows white space, or
    stands before another character, where the gear hash is low: rarely within words, often within
    long runs without white space. It depends on the WINDOW bytes before it, and on whether there is
    white space in the LONG ones, alone, so boundaries come back soon after an insertion."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    found = []
    for a in range(0, len(data), SLICE):
        lead = min(a, LONG)
        part = data[a - lead : a + SLICE]
        h = gear(part)
        at = _SPACE[part] & (h < np.uint32(int(AT_SPACE * 2**32)))
        nxt = np.append(_FIRST[part[1:]], a + SLICE >= len(data) or bool(_FIRST[data[a + SLICE]]))
        gaps = np.concatenate([[0], np.cumsum(_SPACE[part])])
        long_ = np.zeros(len(part), dtype=bool)
        long_[LONG - 1 :] = gaps[LONG:] == gaps[:-LONG] if len(part) >= LONG else False
        at |= nxt & (h < np.where(long_, np.uint32(int(IN_LONG * 2**32)), np.uint32(int(ELSEWHERE * 2**32))))
        at[: WINDOW - 1 if not lead else lead] = False
        found.append(np.flatnonzero(at) + (a - lead) + 1)
    out = np.concatenate(found)
    return out if len(out) and out[-1] == len(data) else np.append(out, len(data))


def _chunks(batches):
    for batch in batches:
        digests, stops = [], []
        for text in batch["text"]:
            raw = (text.as_py() or "").encode()
            cut = ends(np.frombuffer(raw, dtype=np.uint8)).tolist()
            view, a, own = memoryview(raw), 0, []
            for b in cut:
                own.append(xxhash.xxh64_digest(view[a:b], 42))
                a = b
            digests.append(np.frombuffer(b"".join(own), dtype=">i8").astype(np.int64))
            stops.append(cut)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(digests, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int32()))], names=["doc_id", "th", "digest", "stop"])


def chunks(df: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), digest, stop: digests and ends of the chunks of every text."""
    schema = T.StructType([df.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("digest", T.ArrayType(T.LongType())), T.StructField("stop", T.ArrayType(T.IntegerType()))])
    return df.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text").mapInArrow(_chunks, schema)


def repeated_spans(df: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, th, start, length (bytes of the UTF-8 text), n_chunks, first_doc_id: the runs of chunks
    that a document of a smaller id has as well, of `min_bytes` or more.

    A chunk's digest belongs to the smallest id that has it; that document keeps the chunk. Digests
    are counted with a partial aggregate and joined back, so that a very common chunk is one row a
    task on one side and may be split on the other.

    Chunks are compared by 64 bits of hash. Two different ones of all n collide with a chance of about
    n * n / 2**65; a span of `min_bytes` takes several chunks in a row, which must then all collide.

    Null and empty texts have no chunks. Rows of a null id own nothing and lose what others own;
    rows of one id count as one document, repeated rows yield their spans once. An empty table gives
    no rows. Other columns are ignored.
    """
    made = stage(chunks(df), "chunks")
    # the text's hash travels with every chunk only if ids repeat; it does not compress
    twice = made.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    doc = ["doc_id", "th"] if twice else ["doc_id"]
    owners = made.select("doc_id", F.explode("digest").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("loose"))
    owners = owners.filter((F.col("owner") < F.col("last")) | (F.col("loose") & F.col("owner").isNotNull())).select("digest", "owner")
    owners = stage(owners, "owners")  # so that both sides of the join come by plain exchanges, which Spark can split where a chunk is hot
    start = F.when(F.col("pos") > 0, F.get("stop", F.col("pos") - 1)).otherwise(0)
    each = made.select(*doc, "stop", F.posexplode(F.arrays_zip("digest", "stop")).alias("pos", "c"))
    each = each.select(*doc, F.col("c.digest").alias("digest"), start.alias("start"), (F.col("c.stop") - start).alias("size"))
    hit = each.join(owners, "digest").filter(F.col("doc_id").isNull() | (F.col("owner") < F.col("doc_id"))).drop("digest")
    hit = hit.repartition(*doc)  # serves the steps below alike
    if twice:
        hit = hit.distinct()
    at = Window.partitionBy(*doc).orderBy("start")
    opens = F.coalesce(F.lag(F.col("start") + F.col("size")).over(at) != F.col("start"), F.lit(True)).cast("long")
    run = F.sum("opens").over(at.rowsBetween(Window.unboundedPreceding, 0))
    runs = hit.withColumn("opens", opens).withColumn("run", run).groupBy(*doc, "run").agg(F.min("start").cast("long").alias("start"), F.sum("size").cast("long").alias("length"), F.count(F.lit(1)).alias("n_chunks"), F.max_by("owner", F.struct("size", "start")).alias("first_doc_id"))
    spans = runs.filter(F.col("length") >= min_bytes).drop("run")
    if not twice:
        spans = spans.join(made.select(F.col("doc_id").alias("__id"), "th"), F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")
    return spans.select("doc_id", "th", "start", "length", "n_chunks", "first_doc_id")


def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def one(text, spans):
        raw, out, at = text.encode(), [], 0
        for s in sorted(spans, key=lambda x: x["start"]):
            out.append(raw[at : s["start"]])
            at = s["start"] + s["length"]
        return b"".join([*out, raw[at:]]).decode()

    return pd.Series([None if t is None else one(t, g) for t, g in zip(texts, gone)], dtype=object)


def dedup_substrings(df: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """df's columns plus n_repeated (bytes) and kept_text, the text without its repeated spans.

    Null and empty text: n_repeated 0 and an empty kept_text. Repeated rows, and rows of one id with
    the same text, lose the same spans; the document of the smallest id keeps them. Rows of a null id
    lose what others own. An empty table gives no rows. Other columns pass through (n_repeated and
    kept_text are replaced).
    """
    df = df.drop("n_repeated", "kept_text")
    spans = repeated_spans(df, min_bytes)
    gone = spans.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("start", "length")).alias("__gone"), F.sum("length").alias("__n"))
    text, has = F.coalesce(F.col("text"), F.lit("")), F.col("__gone").isNotNull()
    joined = df.withColumn("__h", F.xxhash64(text)).join(gone, (F.col("__h") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    kept = F.when(has, F.pandas_udf(_without, "string")(F.when(has, text), F.col("__gone"))).otherwise(text)
    return joined.withColumn("n_repeated", F.coalesce("__n", F.lit(0))).withColumn("kept_text", kept).drop("__h", "__id", "__th", "__gone", "__n")
