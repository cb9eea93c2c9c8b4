"""Connected components, and greedy leaders over cliques, without gathering a component anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stage

#: Open nodes of a component that one pass of a task settles, the earliest first.
PASS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (a, b) with the smallest node that it is connected to.

    Alternates large-star and small-star steps (linking to the least neighbour), each written to the
    shared folder, until the edges no longer change; no step gathers a node's neighbours.
    """
    pairs = stage(edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    last = None
    while True:  # the edges' ends only ever move to smaller nodes
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        large = stage(large, "large-star")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).filter("x <> y")
        pairs = stage(small.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "small-star")
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if state == last:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        last = state


def _place(ord_):
    """An ord as a value that Python orders as Spark does."""
    return tuple(ord_.values()) if isinstance(ord_, dict) else ord_


def _settled(batches):
    """Rows (root, ord, node, tokens, lead_ord, lead), by root and ord -> node, leader."""
    root, of_token = None, {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["root"] != root:
                root, of_token = r["root"], {}
            met = [of_token[t] for t in r["tokens"] if t in of_token]
            if r["lead"] is not None:
                met.append((_place(r["lead_ord"]), r["lead"]))
            if met:
                out.append((r["node"], min(met)[1]))
            else:
                out.append((r["node"], r["node"]))
                of_token |= dict.fromkeys(r["tokens"], (_place(r["ord"]), r["node"]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], batch.schema.field("node").type) for k in range(2)], names=["node", "leader"])


def greedy_leaders(nodes: DataFrame, tokens: DataFrame, bound: int = PASS) -> DataFrame:
    """node, ord, leader: in order of `ord`, each node joins the first leader among its neighbours or
    becomes a leader.

    nodes: node, ord (unique); tokens: node, token: nodes that share a token are neighbours, so no
    pair of them is ever written. A token has one leader at most, since whoever meets it joins it.

    Every round, a node that comes first in all its tokens without a leader leads, and one whose
    earliest leader comes before all that is open around it joins that. Of the rest, each component's
    first `bound` nodes are settled in one ordered pass, which is exact, as nothing earlier is open.
    Rounds go on until nothing is open; the open table shrinks by at least that much each time.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    own = tokens.select("node", "token").distinct().groupBy("node").agg(F.collect_list("token").alias("tokens"))
    open_ = nodes.select("node", "ord").join(own, "node", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast(own.schema["tokens"].dataType)))
    open_ = stage(open_.withColumn("lead_ord", F.lit(None).cast(nodes.schema["ord"].dataType)).withColumn("lead", F.lit(None).cast(kind)), "open")
    parts = []

    def after(open_: DataFrame, decided: DataFrame) -> DataFrame:
        """What stays open; tokens of new leaders become nodes' earliest leaders."""
        parts.append(decided.select("node", "ord", "leader"))
        led = decided.filter("node = leader").select(F.explode("tokens").alias("token"), F.col("ord").alias("o"), F.col("node").alias("l"))
        still = open_.join(decided.select("node"), "node", "left_anti")
        met = still.select("node", F.explode("tokens").alias("token")).join(led, "token", "left")
        met = met.groupBy("node").agg(F.collect_list(F.when(F.col("l").isNull(), F.col("token"))).alias("now"), F.min(F.when(F.col("l").isNotNull(), F.struct("o", "l"))).alias("m"))
        best = F.least(F.when(F.col("lead").isNotNull(), F.struct(F.col("lead_ord").alias("o"), F.col("lead").alias("l"))), F.col("m"))
        still = still.join(met, "node", "left").withColumn("best", best)
        return stage(still.select("node", "ord", F.coalesce("now", "tokens").alias("tokens"), F.col("best.o").alias("lead_ord"), F.col("best.l").alias("lead")), "open")

    def around(open_: DataFrame) -> DataFrame:
        """node, f: for each of its tokens, the first open node that has it."""
        each = open_.select("node", "ord", F.explode("tokens").alias("token"))
        return each.join(each.groupBy("token").agg(F.min(F.struct("ord", "node")).alias("f")), "token").select("node", "f")

    def settled(rooted: DataFrame) -> DataFrame:
        firsts = rooted.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("ord"))).filter(F.col("n") <= bound)
        ordered = firsts.repartition("root").sortWithinPartitions("root", "ord").select("root", "ord", "node", "tokens", "lead_ord", "lead")
        return stage(ordered.mapInArrow(_settled, f"node {kind}, leader {kind}").join(rooted.select("node", "ord", "tokens"), "node"), "settled")

    while (left := open_.count()) > bound:
        earliest = around(open_).groupBy("node").agg(F.min("f").alias("f"))
        leads = F.col("lead").isNull() & F.coalesce(F.col("f.node") == F.col("node"), F.lit(True))
        joins = F.col("lead").isNotNull() & F.coalesce(F.col("f.ord") > F.col("lead_ord"), F.lit(True))
        judged = open_.join(earliest, "node", "left").withColumn("leader", F.when(leads, F.col("node")).when(joins, F.col("lead")))
        open_ = after(open_, stage(judged.filter("leader IS NOT NULL").select("node", "ord", "leader", "tokens"), "decided"))
        if open_.count() > bound:
            roots = components(around(open_).select(F.col("node").alias("a"), F.col("f.node").alias("b")))
            open_ = after(open_, settled(open_.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))))
    if left:
        parts.append(settled(open_.withColumn("root", F.lit(0))).select("node", "ord", "leader"))
    if not parts:
        return nodes.select("node", "ord", F.col("node").alias("leader"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
