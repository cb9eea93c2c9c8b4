"""Histogram sort: byte-balanced shards from iteratively refined splitters and one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage

SIGN = -(2**63)
FIRST_BITS, MORE_BITS = 12, 8


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col(id_col)).alias("d"),
    )


def _prefix(bits: int) -> tuple[Column, Column]:
    """The first `bits` bits of the 128-bit key (h, d) as two columns; d's part is 0 up to 64 bits."""
    if bits <= 64:
        return F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h"), F.lit(0).cast("long")
    return F.col("h"), F.shiftrightunsigned("d", 128 - bits) if bits < 128 else F.col("d")


def _whole(bits: int, a: int, b: int) -> int:
    """Prefix columns as one non-negative number of `bits` bits."""
    if bits <= 64:
        return a % 2**bits
    return ((a % 2**64) << (bits - 64)) | (b % 2 ** (bits - 64))


def splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[tuple[int, int]]:
    """n_shards - 1 keys (h, d), as signed longs in unsigned order.

    Every round counts, over all rows of the intervals that still hold an unmet splitter, the exact
    bytes of their sub-intervals. A splitter is met when a boundary lies within `tolerance` of a
    shard's share, or when its interval holds one row or one key only; then the nearer end serves. A
    boundary inside a group of equal texts is tried only once no boundary between texts will do.
    What reaches the driver is bounded: 2**12 sums, then 2**8 for each splitter a round.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    want = {j: total * j / n_shards for j in range(1, n_shards)}
    found: dict[int, int] = {}
    bits, step = 0, FIRST_BITS
    #: interval (prefix of `bits` bits) -> (bytes below it, splitters in it)
    open_: dict[int, tuple[int, list[int]]] = {0: (0, list(want))} if total else {}
    while open_:
        rows, at = keys, bits + step
        if bits:
            a, b = _prefix(bits)
            if bits <= 64:
                rows = rows.filter(a.isin([_signed(p, bits) for p in open_]))
            else:
                inside = F.lit(False)
                for p in open_:
                    inside |= (a == _signed(p >> (bits - 64), 64)) & (b == _signed(p % 2 ** (bits - 64), bits - 64))
                rows = rows.filter(inside)
        a, b = _prefix(at)
        got = rows.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1")).collect()
        parts: dict[int, list] = {}
        for r in got:
            q = _whole(at, r["a"], r["b"])
            parts.setdefault(q >> step, []).append((q, r))
        nxt: dict[int, tuple[int, list[int]]] = {}
        one_text: set[int] = set()
        for p, (below, inside_) in open_.items():
            for q, r in sorted(parts[p], key=lambda x: x[0]):
                here = [j for j in inside_ if want[j] <= below + r["w"]]
                inside_ = inside_[len(here) :]  # each splitter lies in the first interval that reaches it
                for j in here:
                    low, high = want[j] - below, below + r["w"] - want[j]
                    single = r["n"] == 1 or at >= 128 or (r["h0"] == r["h1"] and r["d0"] == r["d1"])
                    if single or min(low, high) <= tolerance * total / n_shards:
                        found[j] = (q if low <= high else q + 1) << (128 - at)
                    else:
                        nxt.setdefault(q, (below, []))[1].append(j)
                        if at < 64 and r["h0"] == r["h1"]:
                            one_text.add((q, r["h0"] % 2**64))
                below += r["w"]
        bits, step = at, min(MORE_BITS, 128 - at)
        if nxt and len(one_text) == len(nxt):  # each open interval holds one text: go on by document
            nxt = {h: nxt[q] for q, h in one_text}
            bits, step = 64, MORE_BITS
        elif nxt and bits < 64 < bits + step:
            step = 64 - bits
        open_ = nxt
    last = 2**128 - 1
    return [(_signed(min(k, last) >> 64, 64), _signed(min(k, last) % 2**64, 64)) for k in (found.get(j, 0) for j in want)]


def _signed(x: int, bits: int) -> int:
    return x - 2**64 if bits == 64 and x >= 2**63 else x


def shard_by_bytes(df: DataFrame, n_shards: int = 24, tolerance: float = 0.001, salts: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The sort key is (hash of the text, hash of the id), so equal texts stand together and are parted
    only where a splitter must fall inside their group. The splitters come from `splitters`; rows
    then move once, to (shard, salt), where they get their slots: rows of lower salts in the shard
    plus the row's number. A shard of any size is numbered by `salts` tasks.

    A null text has no bytes and the checksum of an empty one; a null id hashes like any value;
    repeated rows each get a slot of their own; rows with the same id and the same text can't be
    parted. An empty table gives no rows. Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    keys = stage(_keys(df, id_col, text_col), "shard-keys")
    cuts = splitters(keys, n_shards, tolerance)
    key = F.struct(F.col("h").bitwiseXOR(F.lit(SIGN)).alias("h"), F.col("d").bitwiseXOR(F.lit(SIGN)).alias("d"))
    kind = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("d", T.LongType())]))
    if cuts:
        made = F.from_json(F.lit("[" + ",".join(f'{{"h":{h ^ SIGN},"d":{d ^ SIGN}}}' for h, d in cuts) + "]"), kind)
        shard = F.size(F.filter(made, lambda x: x <= key))
    else:
        shard = F.lit(0)
    dealt = keys.select("doc_id", "size", "text_crc32", "h", "d", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("d", "size", "text_crc32"), F.lit(salts)).cast("int").alias("salt"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # n_shards * salts rows at most
    base = dealt.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n")).select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "salt").orderBy("h", "d", "doc_id")
    return (
        dealt.withColumn("rn", F.row_number().over(order))
        .join(F.broadcast(base), ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 24, **how) -> DataFrame:
    """Write df's rows under path, one folder a shard; returns the assignment.

    The rows join their shard by id and checksum, so ids must tell rows of different texts apart.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    dealt = stage(shard_by_bytes(df, n_shards, **how), "shards")
    one = dealt.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), "shard").dropDuplicates(["__id", "__crc"])
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    df.join(one, df[id_col].eqNullSafe(one["__id"]) & (crc == one["__crc"])).drop("__id", "__crc").write.partitionBy("shard").parquet(path)
    return dealt
