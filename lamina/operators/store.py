"""The chunk store: exact dedup, parents, numbering, insert, lookup, restore.

A store row is keyed by (cluster_key, chunk_type, number): the leader of a cluster is its simple chunk
0, chunks stored in full for want of a good delta are simple chunks 1, 2, ... (role `fallback`), deltas
are numbered from 0. Deltas decode against their cluster's leader, so the depth is one.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parts import in_parts
from ..sources.tables import stage
from .cluster import islands, ranges
from .codecs import codec
from .graph import PASS

COLUMNS = ("cluster_key", "chunk_type", "number", "role", "codec", "chunk_id", "payload")
KEY = ("cluster_key", "chunk_type", "number")
SCHEMA = "cluster_key string, chunk_type string, number int, role string, codec string, chunk_id string, payload binary"


def unique_chunks(chunks: DataFrame, ord_cols: tuple = ("stream_id", "chunk_no")) -> DataFrame:
    """chunk_id (SHA-256), ord (struct of the first occurrence), data: each different chunk once."""
    sha = F.col("sha256") if "sha256" in chunks.columns else F.sha2("data", 256)
    return chunks.select(sha.alias("chunk_id"), F.struct(*ord_cols).alias("ord"), "data").groupBy("chunk_id").agg(F.min("ord").alias("ord"), F.first("data").alias("data"))


def known_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose chunk the store holds."""
    return chunks.join(store.select("chunk_id").distinct(), "chunk_id", "left_semi")


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose chunk the store lacks."""
    return chunks.join(store.select("chunk_id"), "chunk_id", "left_anti")


def parents(assigned: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """chunk_id, ord, cluster_key, is_parent: the first member of a cluster, unless the store has the
    cluster's leader already. By aggregate and join, so a hot cluster is not one task."""
    first = assigned.groupBy("cluster_key").agg(F.min("ord").alias("first"))
    out = assigned.join(first, "cluster_key").withColumn("is_parent", F.col("ord") == F.col("first")).drop("first")
    if store is not None:
        led = store.filter("role = 'leader'").select("cluster_key", F.lit(True).alias("led"))
        out = out.join(led, "cluster_key", "left").withColumn("is_parent", F.col("is_parent") & F.col("led").isNull()).drop("led")
    return out.select("chunk_id", "ord", "cluster_key", "is_parent")


def _coder(way: str):
    def run(batches):
        for batch in in_parts(batches, "parent", "data"):
            rows = zip(batch["codec"].to_pylist(), batch["parent"].to_pylist(), batch["data"].to_pylist())
            made = [d if n is None else None if p is None or d is None else getattr(codec(n), way)(p, d) for n, p, d in rows]
            names = [n for n in batch.schema.names if n not in ("parent", "data", "codec")]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(made, pa.binary())], names=[*names, "made"])

    return run


def coded(df: DataFrame, way: str) -> DataFrame:
    """df (…, codec, parent, data) -> (…, made); without a codec, the data itself."""
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in ("parent", "data", "codec"))
    return df.mapInArrow(_coder(way), f"{rest}, made binary")


def _named(led: DataFrame, rows: DataFrame, most: int = 1 << 21) -> DataFrame:
    """The leaders (cluster_key, parent) that rows name, by hash: a few others may stay, for the join
    that follows. Most clusters have no delta, and their leaders' data need not move. Keys beyond `most`
    are not sent to all executors; then all leaders stay."""
    keys = stage(rows.select(F.xxhash64("cluster_key").alias("h")).distinct(), "named")
    return led.join(F.broadcast(keys), F.xxhash64("cluster_key") == F.col("h"), "left_semi") if keys.count() <= most else led


def encode(assigned: DataFrame, chunks: DataFrame, name: str = "gdelta", store: DataFrame | None = None, shrink_only: bool = False) -> DataFrame:
    """Store rows of new chunks. assigned: chunk_id, ord, cluster_key, is_parent; chunks: chunk_id, data.

    Members meet their parent by an equi-join on the cluster key, one row a cluster on the parents'
    side, so a hot cluster may be split. With shrink_only, a delta that is not shorter than its chunk
    becomes a fallback too.
    """
    codec(name)
    whole = assigned.join(chunks.select("chunk_id", "data"), "chunk_id")
    led = whole.filter("is_parent").select("cluster_key", F.col("data").alias("parent"))
    if store is not None:
        led = led.unionByName(store.filter("role = 'leader'").select("cluster_key", F.col("payload").alias("parent")))
    members = whole.filter("NOT is_parent").join(_named(led, assigned.filter("NOT is_parent")), "cluster_key")
    made = coded(members.select("cluster_key", "chunk_id", "ord", F.col("data").alias("raw"), F.lit(name).alias("codec"), "parent", "data"), "encode")
    if shrink_only:
        made = made.withColumn("made", F.when(F.octet_length("made") < F.octet_length("raw"), F.col("made")))
    made = made.withColumn("chunk_type", F.when(F.col("made").isNull(), "simple").otherwise("delta"))
    number = F.row_number().over(Window.partitionBy("cluster_key", "chunk_type").orderBy("ord"))
    start = F.when(F.col("chunk_type") == "simple", number).otherwise(number - 1)
    if store is not None:  # numbers go on from the store's
        taken = store.groupBy("cluster_key", "chunk_type").agg((F.max("number") + 1).alias("taken"))
        made = made.join(taken, ["cluster_key", "chunk_type"], "left")
        start = F.coalesce("taken", F.when(F.col("chunk_type") == "simple", 1).otherwise(0)) + number - 1
    rows = made.select("cluster_key", "chunk_type", start.cast("int").alias("number"), F.when(F.col("chunk_type") == "simple", "fallback").otherwise("member").alias("role"), F.when(F.col("chunk_type") == "delta", name).alias("codec"), "chunk_id", F.coalesce("made", "raw").alias("payload"))
    leaders = whole.filter("is_parent").select("cluster_key", F.lit("simple").alias("chunk_type"), F.lit(0).alias("number"), F.lit("leader").alias("role"), F.lit(None).cast("string").alias("codec"), "chunk_id", F.col("data").alias("payload"))
    return leaders.unionByName(rows)


def decode(rows: DataFrame, store: DataFrame, keep: tuple = ("chunk_id",)) -> DataFrame:
    """chunk_id (or the columns of `keep`), data of store rows: simple chunks as they are, deltas
    decoded against their leader, each row by its own codec. A delta whose leader is missing raises."""
    led = store.filter("role = 'leader'").select("cluster_key", F.col("payload").alias("parent"))
    simple = rows.filter("chunk_type = 'simple'").select(*keep, F.col("payload").alias("data"))
    deltas = rows.filter("chunk_type = 'delta'")
    deltas = deltas.join(_named(led, deltas), "cluster_key", "left")
    deltas = deltas.withColumn("parent", F.coalesce("parent", F.raise_error(F.concat(F.lit("no leader for "), "cluster_key")).cast("binary")))
    return simple.unionByName(coded(deltas.select(*keep, "codec", "parent", F.col("payload").alias("data")), "decode").withColumnRenamed("made", "data"))


def get(store: DataFrame, keys: DataFrame) -> DataFrame:
    """cluster_key, chunk_type, number, data for keys; an unknown key has null data."""
    data = decode(store.join(keys.select(*KEY).distinct(), list(KEY), "left_semi"), store, KEY)
    return keys.join(data, list(KEY), "left").select(*KEY, "data")


def contains(store: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(store.select(*KEY), list(KEY), "left_semi")


def merged(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with rows put in: a row of a key that it has takes that row's place. rows: one a key."""
    return store.join(rows.select(*KEY), list(KEY), "left_anti").select(*COLUMNS).unionByName(rows.select(*COLUMNS))


def insert(rows: DataFrame, path: str) -> None:
    """Put rows into the store at path; keys that it has get the new rows. Where no key is there
    already, rows are only appended; else the store is written anew from a staged copy."""
    spark = rows.sparkSession
    rows = stage(rows.select(*COLUMNS), "inserted")
    try:
        old = read(spark, path)
        again = bool(contains(old, rows).limit(1).count())
    except AnalysisException as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        again = False
    if again:
        write(stage(merged(old, rows), "merged"), path, "overwrite")
    else:
        write(rows, path)


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows as they are; mode overwrite replaces the store."""
    rows.select(*COLUMNS).write.mode(mode).partitionBy("chunk_type").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    write(spark.createDataFrame([], SCHEMA), path, "overwrite")


def manifest(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """stream_id, chunk_no, and the store key of each chunk of each stream (chunks: with chunk_id)."""
    return chunks.select("stream_id", "chunk_no", "chunk_id").join(store.select(*KEY, "chunk_id"), "chunk_id")


def _joined(batches):
    """Rows (stream_id, data) by stream and place -> a row a stream."""
    last, parts, out = None, None, []
    for batch in batches:
        for i, data in zip(batch["stream_id"].to_pylist(), batch["data"]):
            if parts is None or i != last:
                if parts is not None:
                    out.append((last, b"".join(parts)))
                last, parts = i, []
            parts.append(data.as_py())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field("stream_id").type), pa.array([x[1] for x in out], pa.binary())], names=["stream_id", "data"])
            kind, out = batch.schema.field("stream_id").type, []
        else:
            kind = batch.schema.field("stream_id").type
    if parts is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([b"".join(parts)], pa.binary())], names=["stream_id", "data"])


def joined(parts: DataFrame) -> DataFrame:
    """stream_id, data: the parts (stream_id, chunk_no, data) of each stream in order."""
    kind = parts.schema["stream_id"].dataType.simpleString()
    return parts.repartition("stream_id").sortWithinPartitions("stream_id", "chunk_no").select("stream_id", "data").mapInArrow(_joined, f"stream_id {kind}, data binary")


def restore(listed: DataFrame, store: DataFrame) -> DataFrame:
    """stream_id, data: every stream's chunks in order. Each stored chunk is decoded once; the chunks
    are sorted by stream and place, and a task joins one stream after the other."""
    data = decode(store, store)
    return joined(listed.select("stream_id", "chunk_no", "chunk_id").join(data, "chunk_id"))


def probe_cells(wanted: DataFrame, taken: DataFrame, top: int = 2**32 - 1, reach: int | None = None, bound: int = PASS) -> DataFrame:
    """ord, cell, at: in order of `ord` (unique), each wanted cell gets the free cell nearest to it: the
    cell itself, then one above, one below, two above, ... within 0 and top. taken: cell. With `reach`,
    only so many candidates count, those beyond an end included, and without a free one `at` is null;
    else a table that lacks room raises.

    By rounds instead of one after the other: all ask for their next candidate at once, and a cell
    stays with whoever of those that ever asked comes first; the others ask on. As every cell prefers
    the same order, this ends where the sequential search does. Of those that want the same cell, the
    n-th cannot get better than its n-th candidate, so it begins there. A group of any size is spread
    over its candidates.

    Where more than half of the free cells are wanted, rounds would be as many as the longest search,
    so rows go through ordered passes instead, some `bound` at a time, until no cell is free.
    """
    held = stage(taken.filter(F.col("cell").between(0, top)).select(F.col("cell").alias("at")).distinct(), "taken-cells")
    asked = stage(wanted.select("ord", "cell"), "asked")
    free, rows = top + 1 - held.count(), asked.count()
    if reach is None and rows > free:
        raise ValueError("no free cell")
    if 2 * rows > free:
        return _probed_in_order(asked, held, free, rows, top, reach, bound)
    k = F.col("k")
    step = F.floor((k + 1) / 2)
    place = F.col("cell") + F.when(k % 2 == 1, step).otherwise(-step)
    place = place if reach is None else F.when(k < reach, place)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("ord")) - 1
    state = stage(asked.withColumn("k", rank.cast("long")).withColumn("at", place), "asked")
    while True:
        first = state.groupBy("at").agg(F.min("ord").alias("first"))
        full = held.withColumn("full", F.lit(True))
        judged = state.join(first, "at", "left").join(full, "at", "left")
        lost = F.col("at").isNotNull() & (F.col("full").isNotNull() | (F.col("first") != F.col("ord")) | ~F.col("at").between(0, top))
        state = stage(judged.select("ord", "cell", F.when(lost, k + 1).otherwise(k).alias("k"), lost.alias("lost")).withColumn("at", place), "asked")
        if not state.filter("lost").limit(1).count():
            return state.select("ord", "cell", "at")


def _nearest(top: int, reach: int | None):
    """Rows (ord, a, b): without ord, runs of held cells from a to b, ascending; then wanted cells a, by
    ord -> ord, cell, at."""

    def run(batches):
        starts, ends, up, down = [], [], {}, {}

        def free(x, over):
            """The first cell from x on that is not held; `over` has held cells and where to look next."""
            met = []
            while x in over:
                met.append(x)
                x = over[x]
            for m in met:
                over[m] = x
            return x

        for batch in batches:
            out = []
            for o, a, b in zip(batch["ord"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist()):
                if o is None:
                    starts.append(a)
                    ends.append(b)
                    up[a], down[b] = b + 1, a - 1
                    continue
                i = bisect_right(starts, a) - 1
                within = i >= 0 and a <= ends[i]
                above = free(max(0, ends[i] + 1 if within else a), up)
                below = free(min(top, starts[i] - 1 if within else a), down)
                # the candidates' numbers: 0, then odd ones above, even ones below
                near = [(max(0, 2 * (above - a) - 1), above)] * (above <= top) + [(2 * (a - below), below)] * (below >= 0)
                k, at = min(near, default=(None, None))
                if at is not None and reach is not None and k >= reach:
                    at = None
                if at is not None:
                    up[at], down[at] = at + 1, at - 1
                out.append((o, a, at))
            kinds = [batch.schema.field("ord").type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["ord", "cell", "at"])

    return run


def _probed_in_order(asked: DataFrame, held: DataFrame, free: int, rows: int, top: int, reach: int | None, bound: int) -> DataFrame:
    """The search in ordered passes. A task gets the runs of held cells and the next rows, some `bound`;
    after each pass its cells are held too. Rows that come when no cell is free get none."""
    kind = asked.schema["ord"].dataType.simpleString()
    n = max(1, -(-rows // bound))
    cell_kind = asked.schema["cell"].dataType
    dealt = stage(asked.repartitionByRange(n, "ord").withColumn("part", F.spark_partition_id()), "dealt", "part")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    done, size = [], bound
    groups: list[list[int]] = []
    for part, count in sizes:
        if size + count > bound or not groups:
            groups.append([])
            size = 0
        groups[-1].append(part)
        size += count
    while groups and free:
        parts = groups.pop(0)
        runs = islands(held.select(F.col("at").alias("sketch")), 1, ranges(top + 1 - free)).groupBy("island").agg(F.max("sketch").alias("b"))
        runs = runs.select(F.lit(None).cast(kind).alias("ord"), F.col("island").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        batch = dealt.filter(F.col("part").isin(parts)).select("ord", F.col("cell").cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
        ordered = runs.unionByName(batch).repartition(1).sortWithinPartitions(F.asc_nulls_first("ord"), "a")
        got = stage(ordered.mapInArrow(_nearest(top, reach), f"ord {kind}, cell long, at long"), "probed")
        new = got.filter("at IS NOT NULL").select("at")
        free -= new.count()
        held = stage(held.unionByName(new), "taken-cells") if groups and free else held
        done.append(got.withColumn("cell", F.col("cell").cast(cell_kind)))
    late = [p for parts in groups for p in parts]
    out = dealt.filter(F.col("part").isin(late)).select("ord", "cell", F.lit(None).cast("long").alias("at")) if late else None
    for x in done:
        out = x if out is None else out.unionByName(x)
    return asked.withColumn("at", F.lit(None).cast("long")) if out is None else out
