"""Clusterers over sketches, and their metrics.

Members come in order of `ord`, the place of a chunk's first occurrence; the reference point of every
tie is the lowest `ord`.
"""

from __future__ import annotations

import bisect
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stage
from .graph import PASS, greedy_leaders

WIDTH = 10


def equal_clusters(sketched: DataFrame, key: str = "sketch") -> DataFrame:
    """chunk_id, ord, cluster_key: chunks of equal sketches; one null sketch is a sketch like others."""
    return sketched.select("chunk_id", "ord", F.sha2(F.coalesce(F.to_json(F.struct(key)), F.lit("")), 256).alias("cluster_key"))


def similar_pairs(keys: DataFrame, least: int) -> DataFrame:
    """a, b, shared: pairs of keys (key, features) with equal features at `least` places or more; a < b.

    An equi-join on (place, value) over different keys only, so copies of a sketch cost nothing; no
    pair of keys without a common value is ever formed. It lists all pairs, which a value of n keys
    has n * (n - 1) / 2 of: a report for reading. The clusterer does without (see `partial_clusters`).
    """
    each = keys.select("key", F.posexplode("features").alias("pos", "value"))
    return each.alias("x").join(each.alias("y"), (F.col("x.pos") == F.col("y.pos")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.key") < F.col("y.key"))).groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def partial_clusters(sketched: DataFrame, features: str = "super_features", mismatches: int = 6, bound: int = PASS) -> DataFrame:
    """chunk_id, ord, cluster_key: equal sketches first; another joins the earliest cluster whose key
    has fewer than `mismatches` differing places, else it starts one. mismatches 0 or 1: equality.

    Keys with equal values at `least` places share a token for one of the sets of `least` places, of
    which six places have 20 at most; so no pair of similar keys is written, however many share a value.
    Sketches without features (no sampled place) are one cluster.
    """
    keyed = sketched.withColumn("key", F.sha2(F.coalesce(F.concat_ws(",", features), F.lit("")), 256))
    keyed = stage(keyed.select("chunk_id", "ord", "key", features), "keyed")
    keys = keyed.groupBy("key").agg(F.min("ord").alias("ord"), F.first(features).alias("features"))
    if mismatches <= 1:
        return keyed.select("chunk_id", "ord", F.col("key").alias("cluster_key"))
    n = keys.select(F.max(F.size("features"))).first()[0] or 0
    least = max(1, n - mismatches + 1)
    sets = [F.sha2(F.concat_ws(",", F.lit(",".join(map(str, at))), *(F.get("features", F.lit(i)) for i in at)), 256) for at in combinations(range(n), least)]
    tokens = keys.filter(F.col("features").isNotNull()).select(F.col("key").alias("node"), F.explode(F.array(*sets)).alias("token")) if sets else keys.select(F.col("key").alias("node"), F.lit("").alias("token")).limit(0)
    led = greedy_leaders(keys.select(F.col("key").alias("node"), "ord"), tokens, bound)
    return keyed.join(led.select(F.col("node").alias("key"), F.col("leader").alias("cluster_key")), "key").select("chunk_id", "ord", "cluster_key")


def islands(keys: DataFrame, width: int = WIDTH, parts: int = 64) -> DataFrame:
    """sketch, island: runs of different sketches with gaps of at most `width`; an island's name is
    its least sketch.

    Each of `parts` ranges of the 32-bit space finds its own runs; the ranges' first and last sketches
    (a row a range) then tell which first run goes on one of an earlier range. No global sort.
    """
    span = -(-(1 << 32) // parts)
    k = keys.select("sketch").distinct().withColumn("range", F.floor(F.col("sketch") / span))
    order = Window.partitionBy("range").orderBy("sketch")
    k = k.withColumn("head", F.when(F.col("sketch") - F.coalesce(F.lag("sketch").over(order), F.col("sketch") - (width + 1)) > width, F.col("sketch")))
    k = k.withColumn("local", F.last("head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = k.groupBy("range").agg(F.min("sketch").alias("first"), F.max("sketch").alias("last"), F.max("local").alias("last_run"))
    line = Window.orderBy("range")  # at most `parts` rows
    e = ends.withColumn("joins", F.coalesce(F.col("first") - F.lag("last").over(line) <= width, F.lit(False)))
    # a range's last run begins earlier if the range is one run that goes on the one before
    begin = F.when(~(F.col("joins") & (F.col("last_run") == F.col("first"))), F.col("last_run"))
    e = e.withColumn("run_begin", F.last(begin, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    e = e.withColumn("goes_on", F.when(F.col("joins"), F.lag("run_begin").over(line)))
    return k.join(F.broadcast(e.select("range", "first", "goes_on")), "range").select("sketch", F.when((F.col("local") == F.col("first")) & F.col("goes_on").isNotNull(), F.col("goes_on")).otherwise(F.col("local")).alias("island"))


def ranges(rows: int) -> int:
    """Ranges of the 32-bit space for so many sketches: some thousands each, 2**20 at most."""
    return max(64, min(1 << 20, rows // 10_000))


def _led(width: int):
    """Rows (island, sketch), by island and ord -> the leaders of an ordered pass."""

    def run(batches):
        island, led = None, []
        for batch in batches:
            new = []
            for i, s in zip(batch["island"].to_pylist(), batch["sketch"].to_pylist()):
                if i != island:
                    island, led = i, []
                at = bisect.bisect_left(led, s)
                if all(abs(x - s) > width for x in led[max(0, at - 1) : at + 1]):
                    led.insert(at, s)
                    new.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], names=["sketch"])

    return run


def _buckets(width: int, sketch: str = "sketch"):
    """The cell of a sketch and the two beside it: cells are width + 1 wide, so they hold all within
    `width`, and a cell holds one leader at most."""
    cell = F.floor(F.col(sketch) / (width + 1))
    return F.explode(F.array(cell - 1, cell, cell + 1))


def leader_clusters(sketched: DataFrame, width: int = WIDTH, known: DataFrame | None = None, bound: int = PASS) -> DataFrame:
    """chunk_id, ord, sketch, cluster_key: greedy one-dimensional leader clustering: in order of `ord`
    (any type that sorts), each chunk joins the nearest leader within `width` (the smaller of two as
    near) or leads. `known` (leader) are leaders of earlier runs, which come before all.

    Leaders first: only a sketch's first occurrence can lead, and does if no leader is within width.
    Every round, of each island of open sketches (runs with gaps of at most `width`) the first `bound`
    go through an ordered pass; where an island is larger, the first sketch of each cell that no open
    neighbour precedes leads as well. What is within `width` of a leader is closed, and the rest falls
    into smaller islands, until none is open. No island is gathered beyond `bound`.

    Then each chunk picks among the leaders of its cell's surroundings, three at most, that were there
    before it; a sketch's repeats may thus be led differently.
    """
    if width < 0:
        raise ValueError("width must not be negative")
    ord_type = sketched.schema["ord"].dataType.simpleString()
    open_ = stage(sketched.groupBy("sketch").agg(F.min("ord").alias("ord")), "open-sketches")
    firsts = open_
    leaders = []
    if known is not None:
        leaders.append(known.select(F.col("leader").cast("long").alias("sketch")).distinct().withColumn("ord", F.lit(None).cast(ord_type)))
        open_ = stage(_uncovered(open_, leaders[0], width), "open-sketches")
    while left := open_.count():
        parts = ranges(left)
        isle = open_.join(islands(open_, width, parts), "sketch")
        ordered = isle.withColumn("n", F.row_number().over(Window.partitionBy("island").orderBy("ord"))).filter(F.col("n") <= bound)
        ordered = ordered.repartition("island").sortWithinPartitions("island", "ord").select("island", "sketch")
        new = ordered.mapInArrow(_led(width), "sketch long")
        if left > bound:
            cell = F.floor(F.col("sketch") / (width + 1))
            heads = open_.groupBy(cell.alias("cell")).agg(F.min(F.struct("ord", "sketch")).alias("h"))
            around = open_.select("sketch", "ord", _buckets(width).alias("cell")).join(heads, "cell")
            blocked = F.max((F.col("ord") < F.col("h.ord")) & (F.abs(F.col("sketch") - F.col("h.sketch")) <= width))
            new = new.unionByName(around.groupBy(F.col("h.sketch").alias("sketch")).agg(blocked.alias("b")).filter("NOT b").select("sketch")).distinct()
        new = stage(new.join(firsts, "sketch").select("sketch", "ord"), "new-leaders")
        leaders.append(new)
        open_ = stage(_uncovered(open_, new, width), "open-sketches")
    if not leaders:
        return sketched.select("chunk_id", "ord", "sketch", F.col("sketch").alias("cluster_key"))
    every = leaders[0]
    for x in leaders[1:]:
        every = every.unionByName(x)
    # three leaders a cell at most, and as many known ones
    near = every.select(F.struct(F.col("sketch").alias("l"), F.col("ord").alias("o")).alias("x"), _buckets(width).alias("cell")).groupBy("cell").agg(F.collect_list("x").alias("near"))
    rows = sketched.select("chunk_id", "ord", "sketch", F.floor(F.col("sketch") / (width + 1)).alias("cell")).join(near, "cell")
    there = F.filter("near", lambda x: (F.abs(x["l"] - F.col("sketch")) <= width) & (x["o"].isNull() | (x["o"] <= F.col("ord"))))
    best = F.array_min(F.transform(there, lambda x: F.struct(F.abs(x["l"] - F.col("sketch")), x["l"].alias("l"))))
    return rows.select("chunk_id", "ord", "sketch", best["l"].alias("cluster_key"))


def _uncovered(open_: DataFrame, leaders: DataFrame, width: int) -> DataFrame:
    """The open sketches that are farther than `width` from all leaders."""
    near = leaders.select(F.col("sketch").alias("l"), _buckets(width).alias("cell"))
    cell = F.floor(F.col("sketch") / (width + 1))
    hit = open_.select("sketch", cell.alias("cell")).join(near, "cell").filter(F.abs(F.col("sketch") - F.col("l")) <= width)
    return open_.join(hit.select("sketch").distinct(), "sketch", "left_anti")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"))


def member_distances(assigned: DataFrame) -> DataFrame:
    """cluster_key, chunk_id, distance of every member but those at the leader itself."""
    d = F.abs(F.col("sketch") - F.col("cluster_key"))
    return assigned.select("cluster_key", "chunk_id", d.alias("distance")).filter("distance > 0")


def leader_distances(assigned: DataFrame, parts: int = 64) -> DataFrame:
    """leader, below, above: distances to the next leaders on either side. The nearest-neighbour form
    of the all-pairs lists: linear, by ranges of the 32-bit space."""
    span = -(-(1 << 32) // parts)
    led = assigned.select(F.col("cluster_key").alias("leader")).distinct().withColumn("range", F.floor(F.col("leader") / span))
    ends = led.groupBy("range").agg(F.min("leader").alias("first"), F.max("leader").alias("last"))
    line = Window.orderBy("range")
    ends = ends.select("range", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    order = Window.partitionBy("range").orderBy("leader")
    near = led.withColumn("b", F.lag("leader").over(order)).withColumn("a", F.lead("leader").over(order)).join(F.broadcast(ends), "range")
    return near.select("leader", (F.col("leader") - F.coalesce("b", "before")).alias("below"), (F.coalesce("a", "after") - F.col("leader")).alias("above"))


def all_leader_distances(assigned: DataFrame, block: int = 2048, tasks: int = 4096) -> DataFrame:
    """a, b, distance of all ordered pairs of leaders: quadratic in its result. The leaders come in
    blocks, each an array, and each pair of blocks meets in one task, which lists it a row at a time;
    none is broadcast. The pairs of blocks are dealt to a task each, up to `tasks`: they are small
    beside what they list, so their size must not tell how many tasks there are."""
    led = stage(assigned.select(F.col("cluster_key").alias("leader")).distinct(), "leaders")
    n = max(1, -(-led.count() // block))
    every, own = F.explode(F.sequence(F.lit(0), F.lit(n - 1))), F.pmod(F.xxhash64("leader"), F.lit(n)).cast("int")
    blocks = stage(led.groupBy(own.alias("k")).agg(F.sort_array(F.collect_list("leader")).alias("own")), "leader-blocks")
    dealt = min(n * n, tasks)
    a = blocks.select(F.col("own").alias("x"), F.col("k").alias("i"), every.alias("j")).repartition(dealt, "i", "j")
    b = blocks.select(F.col("own").alias("y"), every.alias("i"), F.col("k").alias("j")).repartition(dealt, "i", "j")
    pairs = a.join(b.hint("merge"), ["i", "j"]).select("y", F.explode("x").alias("a")).select("a", F.explode("y").alias("b"))
    return pairs.filter("a <> b").select("a", "b", F.abs(F.col("a") - F.col("b")).alias("distance"))


def cluster_report(assigned: DataFrame) -> DataFrame:
    """One row: total, clusters, largest, singletons."""
    s = cluster_sizes(assigned)
    return s.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count(F.when(F.col("size") == 1, 1)).alias("singletons"))
