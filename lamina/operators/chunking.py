"""Content-defined chunking."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gear import as_array, gear_sql, rolling
from ..functions.parts import in_parts

#: A piece ends before a byte where the low BITS bits of the gear hash are 2**(BITS - 1).
BITS = 13


def gear_ends(data: bytes, bits: int = BITS) -> np.ndarray:
    """Ends of the pieces of data, its length included; none for no data."""
    x = as_array(data)
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    h = rolling(x, 32)
    cut = np.flatnonzero((h & np.uint32(2**bits - 1)) == np.uint32(1 << (bits - 1)))
    return np.append(cut[cut > 0], len(x))


def clamped_ends(data: bytes, least: int, average: int, most: int) -> np.ndarray:
    """Ends with a least, an average and a greatest size: the first boundary of the gear hash after
    `least` bytes, at `most` bytes without one."""
    if not 0 < least <= average <= most:
        raise ValueError("sizes must be positive and ascending")
    x = as_array(data)
    h = rolling(x, 32) if len(x) else x
    marks = np.flatnonzero(h < np.uint32(min(2**32 - 1, 2**32 // max(1, average - least)))) + 1 if len(x) else []
    out, at = [], 0
    while len(x) - at > least:
        k = int(np.searchsorted(marks, at + least))
        nxt = int(marks[k]) if k < len(marks) else len(x)
        at = min(nxt, at + most, len(x))
        out.append(at)
    if not out or out[-1] < len(x):
        out += [len(x)] if len(x) else []
    return np.array(out, dtype=np.int64)


def normalised_ends(data: bytes, least: int, average: int, most: int, level: int = 2) -> np.ndarray:
    """Ends by two thresholds: up to the average size boundaries are 2**level times rarer than one in
    `average`, after it as much more frequent, so sizes gather around the average. Where none comes up
    to `most`, the last place four times as easy ends the chunk, and only without one the size does."""
    if not 0 < least <= average <= most or level < 0:
        raise ValueError("sizes must be positive and ascending")
    x = as_array(data)
    h = rolling(x, 32) if len(x) else x.astype(np.uint32)
    below = lambda share: np.flatnonzero(h < np.uint32(min(2**32 - 1, int(2**32 * share)))) + 1
    hard, easy, spare = below(2.0**-level / average), below(min(1.0, 2.0**level / average)), below(min(1.0, 4 * 2.0**level / average))
    out, at = [], 0
    while len(x) - at > least:
        middle, end = min(at + average, len(x)), min(at + most, len(x))
        k = int(np.searchsorted(hard, at + least))
        if k < len(hard) and hard[k] <= middle:
            nxt = int(hard[k])
        else:
            k = int(np.searchsorted(easy, max(at + least, middle + 1)))
            nxt = int(easy[k]) if k < len(easy) and easy[k] <= end else end
            if nxt == end == at + most:
                j = int(np.searchsorted(spare, end, side="right")) - 1
                nxt = int(spare[j]) if j >= 0 and spare[j] >= at + least else end
        out.append(nxt)
        at = nxt
    if len(x) and (not out or out[-1] < len(x)):
        out.append(len(x))
    return np.array(out, dtype=np.int64)


def _chunker(ends_of):
    def run(batches):
        for batch in in_parts(batches, "data"):
            ids, nos, at, size, sha, raw = [], [], [], [], [], []
            for i, data in zip(batch["stream_id"].to_pylist(), batch["data"]):
                data, a = data.as_py() or b"", 0
                for k, b in enumerate(ends_of(data).tolist()):
                    part = data[a:b]
                    for col, v in zip((ids, nos, at, size, sha, raw), (i, k, a, b - a, hashlib.sha256(part).hexdigest(), part)):
                        col.append(v)
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(sha, pa.string()), pa.array(raw, pa.binary())], names=["stream_id", "chunk_no", "offset", "length", "sha256", "data"])

    return run


CHUNKS = "stream_id long, chunk_no int, offset long, length int, sha256 string, data binary"


def gear_chunks(streams: DataFrame, bits: int = BITS) -> DataFrame:
    """Chunks of streams (stream_id, data): a narrow map, no shuffle. Null or empty data: no chunk."""
    return streams.select("stream_id", "data").mapInArrow(_chunker(lambda d: gear_ends(d, bits)), CHUNKS)


def clamped_chunks(streams: DataFrame, least: int = 2048, average: int = 8192, most: int = 16384) -> DataFrame:
    """Chunks of bounded size."""
    if not 0 < least <= average <= most:
        raise ValueError("sizes must be positive and ascending")
    return streams.select("stream_id", "data").mapInArrow(_chunker(lambda d: clamped_ends(d, least, average, most)), CHUNKS)


def normalised_chunks(streams: DataFrame, least: int = 2048, average: int = 8192, most: int = 16384, level: int = 2) -> DataFrame:
    """Chunks of bounded size that gather around the average."""
    if not 0 < least <= average <= most or level < 0:
        raise ValueError("sizes must be positive and ascending")
    return streams.select("stream_id", "data").mapInArrow(_chunker(lambda d: normalised_ends(d, least, average, most, level)), CHUNKS)


#: Bytes of a text that one row of the built-in forms has.
SPAN = 4096


def byte_spans(df: DataFrame, id_col: str, data: Column, window: int) -> DataFrame:
    """id_col, at, bytes: data in spans of SPAN bytes by built-ins, `at` being the place of the first.
    `bytes` is an array that begins with the window - 1 bytes before (256 where there are none)."""
    rows = df.select(id_col, data.alias("data")).filter(F.octet_length("data") > 0)
    rows = rows.select(id_col, "data", F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1, F.lit(SPAN))).alias("at"))
    before = F.least("at", F.lit(window - 1))
    part = F.decode(F.substring("data", F.col("at") - before + 1, before + SPAN), "ISO-8859-1")
    own = F.transform(F.split(part, ""), F.ascii)
    return rows.select(id_col, "at", F.concat(F.array_repeat(F.lit(256), F.lit(window - 1) - before), own).alias("bytes"))


def gear_hits(df: DataFrame, id_col: str, data: Column, bits: int, value: int, window: int = 32) -> DataFrame:
    """id_col, i, v, h of the places where the low `bits` bits of the gear hash are `value`, by built-ins:
    place, byte and the 32-bit hash of up to `window` bytes. A narrow map: a hash of b bits forgets what
    is b bytes back, so each place looks up its own last bytes, and no row a byte is moved or sorted."""
    spans = byte_spans(df, id_col, data, window)
    rows = spans.select(id_col, "at", "bytes", F.explode(F.sequence(F.lit(window - 1), F.size("bytes") - 1)).alias("k"))

    def hashed(n: int, of: int):
        table = F.array(*map(F.lit, [*gear_sql(of), 0]))
        terms = [F.get(table, F.get("bytes", F.col("k") - j)).cast("long") * (1 << j) for j in range(n)]
        return sum(terms[1:], terms[0]).bitwiseAND(F.lit((1 << of) - 1))

    few = min(bits, 7)  # looked up at every place; the rest of the bits where these agree
    hits = rows.filter(hashed(few, few) == value % (1 << few))
    hits = hits if few == bits else hits.filter(hashed(min(bits, window), bits) == value)
    table = F.array(*map(F.lit, [*gear_sql(32), 0]))
    last = F.slice("bytes", F.col("k") - window + 2, window)
    whole = F.aggregate(last, F.lit(0).cast("long"), lambda h, v: (h * 2 + F.get(table, v)).bitwiseAND(F.lit((1 << 32) - 1)))
    return hits.select(id_col, (F.col("at") + F.col("k") - (window - 1)).alias("i"), F.get("bytes", "k").alias("v"), whole.alias("h"))


def gear_cuts(df: DataFrame, id_col: str, data: Column, bits: int = BITS) -> DataFrame:
    """id_col, cut: places that a piece ends before, by built-ins."""
    hits = gear_hits(df, id_col, data, bits, 1 << (bits - 1), max(16, bits))
    return hits.filter("i > 0").select(id_col, F.col("i").cast("long").alias("cut"))
