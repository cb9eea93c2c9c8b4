"""Similarity sketches of byte strings.

Spectral: 32 bits from the shapes of the byte and pair frequency spectra. Gear-sampled: the least
values of seeded linear transforms over content-sampled places. Both come as numpy functions in a
narrow map (the fast path: no shuffle) and, column by column, as DataFrame built-ins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ansi import mul_add_mod32
from ..functions.gear import as_array, rolling
from ..functions.parts import in_parts
from .chunking import gear_hits

GAPS, LEAST_COUNT, FULL_RANKS = 8, 50, 16
SHIFTS = (0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 6)
PAIR_RANKS = range(5, 9)
M32 = (1 << 32) - 1
#: Seeded coefficients of the linear transforms: sketches of different runs compare.
RATE, GROUPS, SUPERS = 7, 2, 6


def coefficients(n: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"coefficient {i}".encode()).digest()[:4], "big") | 1 for i in range(n)]


# -- spectral, numpy ---------------------------------------------------------------------------


def gap_part(ranked: list[tuple[int, int]]) -> int:
    """From (byte, count) by falling count: bytes between the widest gaps of the spectrum."""
    gaps = [((c - d) * (i + 1), i) for i, ((_, c), (_, d)) in enumerate(zip(ranked, ranked[1:])) if c > d >= LEAST_COUNT]
    out, start = 0, 0
    for k, (_, end) in enumerate(sorted(sorted(gaps, key=lambda g: (-g[0], g[1]))[:GAPS], key=lambda g: g[1])):
        block = 0
        for b, _ in ranked[start : end + 1]:
            block ^= b
        out ^= block << 3 * (GAPS - k) & M32
        start = end + 1
    return out


def count_part(ranked: list[tuple[int, int]]) -> int:
    """The three bits after the leading one of each of the largest counts."""
    out = 0
    for (_, c), s in zip(ranked, SHIFTS):
        out ^= (8 * c >> c.bit_length() - 1) % 8 << s
    return out


def pair_mix(a: int, b: int) -> int:
    return ((a << 3 | a >> 5) & 255) << 4 ^ ((b >> 3 | b << 5) & 255)


def pair_part(pairs: list[tuple[tuple[int, int], int]]) -> int:
    """From ((a, b), count) by falling count: the pairs after the most frequent ones."""
    out = 0
    for k in PAIR_RANKS:
        if k < len(pairs):
            out ^= pair_mix(*pairs[k][0]) << 20
    return out


def ranked_counts(counts: dict) -> list:
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def spectral_sketch(data: bytes) -> int:
    """0 for no data."""
    x = as_array(data)
    if not len(x):
        return 0
    c = np.bincount(x, minlength=256)
    own = np.flatnonzero(c)
    own = own[np.argsort(-c[own], kind="stable")]
    ranked = list(zip(own.tolist(), c[own].tolist()))
    two = x[:-1].astype(np.int32) << 8 | x[1:]
    p = np.bincount(two, minlength=65536)
    some = np.flatnonzero(p)
    need = PAIR_RANKS.stop
    if len(some) > need:  # the order matters for the first ranks only
        floor = np.partition(p[some], len(some) - need)[len(some) - need]
        some = some[p[some] >= floor]
    some = some[np.argsort(-p[some], kind="stable")][:need]
    pairs = [((int(k) >> 8, int(k) & 255), int(p[k])) for k in some]
    return gap_part(ranked) ^ count_part(ranked) ^ pair_part(pairs)


# -- gear-sampled, numpy -----------------------------------------------------------------------


def gear_features(data: bytes, n: int, rate: int = RATE) -> tuple[int, list[int] | None]:
    """(sampled places, features); no features without a sampled place."""
    x = as_array(data)
    h = rolling(x, 32) if len(x) else np.zeros(0, dtype=np.uint32)
    at = np.flatnonzero((h & np.uint32(2**rate - 1)) == 0)
    if not len(at):
        return 0, None
    coef = np.array(coefficients(n), dtype=np.uint32)
    t = h[at][:, None] * coef[None, :] + x[at][:, None].astype(np.uint32)
    return len(at), [int(v) for v in t.min(axis=0)]


def super_features(features: list[int] | None, groups: int = GROUPS, supers: int = SUPERS) -> list[str] | None:
    """Digest k joins the k-th least feature of each run of `supers` features."""
    if features is None:
        return None
    runs = [sorted(features[g * supers : (g + 1) * supers]) for g in range(groups)]
    return [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in zip(*runs)]


def _sketcher(kind: str, keep: tuple, rate: int, groups: int, supers: int):
    def run(batches):
        for batch in in_parts(batches, "data"):
            data = [x.as_py() or b"" for x in batch["data"]]
            if kind == "spectral":
                cols = [pa.array([spectral_sketch(d) for d in data], pa.int64())]
                names = ["sketch"]
            else:
                made = [gear_features(d, groups * supers, rate) for d in data]
                cols = [pa.array([n for n, _ in made], pa.int64()), pa.array([f for _, f in made], pa.list_(pa.int64())), pa.array([super_features(f, groups, supers) for _, f in made], pa.list_(pa.string()))]
                names = ["n_samples", "features", "super_features"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), *cols], names=[*keep, *names])

    return run


def sketches(chunks: DataFrame, kind: str = "gear", rate: int = RATE, groups: int = GROUPS, supers: int = SUPERS, keep: tuple = ("chunk_id",)) -> DataFrame:
    """chunk_id (or the columns of `keep`) and its sketch, of chunks (chunk_id, data): `spectral` gives
    sketch; `gear` gives n_samples, features, super_features (null without samples)."""
    if kind not in ("spectral", "gear"):
        raise ValueError(f"unknown sketch {kind!r}")
    if groups < 1 or supers < 1 or not 0 <= rate < 32:
        raise ValueError("groups, supers and rate must be positive")
    kept = ", ".join(f"{n} {chunks.schema[n].dataType.simpleString()}" for n in keep)
    made = "sketch long" if kind == "spectral" else "n_samples long, features array<long>, super_features array<string>"
    return chunks.select(*keep, "data").mapInArrow(_sketcher(kind, keep, rate, groups, supers), f"{kept}, {made}")


# -- spectral, built-ins -----------------------------------------------------------------------


def _counts(df: DataFrame, id_col: str, data: Column, n: int) -> DataFrame:
    """id_col, x, c: the runs of n bytes as numbers, and their counts. They are cut out of the data and
    counted as they are; only the different ones of a row become numbers."""
    rows = df.select(id_col, data.alias("data")).filter(F.octet_length("data") >= n)
    rows = rows.select(id_col, "data", F.explode(F.sequence(F.lit(1), F.octet_length("data") - (n - 1))).alias("k"))
    rows = rows.select(id_col, F.substring("data", F.col("k"), F.lit(n)).alias("x")).groupBy(id_col, "x").agg(F.count(F.lit(1)).alias("c"))
    return rows.select(id_col, F.conv(F.hex("x"), 16, 10).cast("int").alias("x"), "c")


def byte_histogram(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """id_col, v, c: counts of bytes."""
    return _counts(df, id_col, data, 1).withColumnRenamed("x", "v")


def pair_histogram(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """id_col, a, b, c: counts of adjacent pairs."""
    return _counts(df, id_col, data, 2).select(id_col, F.shiftright("x", 8).alias("a"), (F.col("x") % 256).alias("b"), "c")


def spectrum_c(hist: DataFrame, id_col: str) -> DataFrame:
    rank = Window.partitionBy(id_col).orderBy(F.desc("c"), "v")
    r = hist.withColumn("i", F.row_number().over(rank) - 1).withColumn("d", F.lead("c").over(rank))
    r = r.withColumn("gap", F.when((F.col("c") > F.col("d")) & (F.col("d") >= LEAST_COUNT), (F.col("c") - F.col("d")) * (F.col("i") + 1)))
    widest = Window.partitionBy(id_col).orderBy(F.desc_nulls_last("gap"), "i")
    r = r.withColumn("kept", F.col("gap").isNotNull() & (F.row_number().over(widest) <= GAPS))
    # block of a rank: kept gaps before it; ranks after the last kept gap have no end
    before = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("block", F.coalesce(F.sum(F.col("kept").cast("int")).over(before), F.lit(0)))
    own = r.groupBy(id_col, "block").agg(F.bit_xor("v").alias("x"), F.max("kept").alias("ended")).filter("ended")
    bits = F.expr(f"shiftleft(CAST(x AS BIGINT), CAST(3 * ({GAPS} - block) AS INT))").bitwiseAND(F.lit(M32))
    return own.select(id_col, bits.alias("x")).groupBy(id_col).agg(F.bit_xor("x").alias("hash"))


def spectrum_f(hist: DataFrame, id_col: str) -> DataFrame:
    rank = Window.partitionBy(id_col).orderBy(F.desc("c"), "v")
    r = hist.withColumn("i", F.row_number().over(rank)).filter(F.col("i") <= FULL_RANKS)
    shift = F.element_at(F.array(*map(F.lit, SHIFTS)), F.col("i"))
    three = F.expr("shiftright(c * 8, length(bin(c)) - 1)") % 8
    return r.select(id_col, F.call_function("shiftleft", three.cast("long"), shift).alias("x")).groupBy(id_col).agg(F.bit_xor("x").alias("hash"))


def spectrum_p(pairs: DataFrame, id_col: str) -> DataFrame:
    rank = Window.partitionBy(id_col).orderBy(F.desc("c"), "a", "b")
    r = pairs.withColumn("i", F.row_number().over(rank)).filter(F.col("i").between(PAIR_RANKS.start + 1, PAIR_RANKS.stop))
    a = (F.col("a") * 8) % 256 + F.floor(F.col("a") / 32)
    b = F.floor(F.col("b") / 8) + (F.col("b") * 32) % 256
    mixed = (a * 16).cast("long").bitwiseXOR(b.cast("long")) * (1 << 20)
    return r.select(id_col, mixed.alias("x")).groupBy(id_col).agg(F.bit_xor("x").alias("hash"))


def spectral_native(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """id_col, sketch: the three parts combined, by built-ins only. A byte begins a pair or is the last,
    so its count comes from those of the pairs, and the data is gone through once."""
    pairs = pair_histogram(df, id_col, data)
    last = df.select(id_col, data.alias("data")).filter(F.octet_length("data") > 0)
    last = last.select(id_col, F.conv(F.hex(F.substring("data", F.octet_length("data"), F.lit(1))), 16, 10).cast("int").alias("v"), F.lit(1).cast("long").alias("c"))
    hist = pairs.select(id_col, F.col("a").alias("v"), "c").unionByName(last).groupBy(id_col, "v").agg(F.sum("c").alias("c"))
    parts = [spectrum_c(hist, id_col), spectrum_f(hist, id_col), spectrum_p(pairs, id_col)]
    every = df.select(id_col, F.lit(0).cast("long").alias("hash"))
    for p in parts:
        every = every.unionByName(p)
    return every.groupBy(id_col).agg(F.bit_xor("hash").alias("sketch"))


# -- gear-sampled, built-ins -------------------------------------------------------------------


def gear_samples_native(df: DataFrame, id_col: str, data: Column, rate: int = RATE) -> DataFrame:
    """id_col, n_samples, by built-ins."""
    hit = gear_hits(df, id_col, data, rate, 0, max(8, rate)).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return df.select(id_col).join(hit, id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_samples"))


def gear_features_native(df: DataFrame, id_col: str, data: Column, n: int = GROUPS * SUPERS, rate: int = RATE) -> DataFrame:
    """id_col, pos, value: features of rows with a sample, by built-ins."""
    h = gear_hits(df, id_col, data, rate, 0)
    made = h.groupBy(id_col).agg(*(F.min(mul_add_mod32(c, F.col("h"), F.col("v"))).alias(f"f{i}") for i, c in enumerate(coefficients(n))))
    return made.select(id_col, F.posexplode(F.array(*(f"f{i}" for i in range(n)))).alias("pos", "value"))
