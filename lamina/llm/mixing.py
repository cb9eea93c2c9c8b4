"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, stage

WEIGHTS = (5, 2, 1)
#: Bits of the shuffled order's buckets, and buckets of virtual time, least and most: sums go bucket by
#: bucket, so that neither a hot source nor the global order is one task. Between the two there is a
#: bucket for each BUCKET_ROWS documents.
ORDER_BITS, TIME_BUCKETS, BUCKET_ROWS = (10, 20), (4096, 1 << 20), 1 << 14
HASH_BITS = 60


def shuffled(seed: int, id_: Column) -> Column:
    """The first 60 bits of the MD5 of seed and id, which other engines have too; 0 for a null id."""
    made = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string")).cast("binary")), 1, HASH_BITS // 4), 16, 10)
    return F.coalesce(made.cast("long"), F.lit(0))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """skey, source_size, target of each source of `sizes` (skey, source, size).

    Sources by code point, null last, get the weights in turn and share budget * all sizes by
    weight; no target exceeds repeats * the source's size, and what is above goes to the others by
    weight. Sorted by cap / weight the capped sources are a prefix, so one pass over the sources
    finds the level that repeated resharing ends at.
    """
    total = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("i") - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = total.withColumn("i", F.row_number().over(by_name)).withColumn("w", w).withColumn("cap", F.col("source_size") * float(repeats))
    level = Window.orderBy(F.col("cap") / F.col("w"), "i")
    all_ = Window.partitionBy()
    return (
        ranked.withColumn("budget", F.sum("source_size").over(all_) * float(budget))
        .withColumn("capped", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("i"), F.col("level")))).over(all_)["level"])
        .select("skey", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))
    )


def _packets(df: DataFrame, weights: tuple, budget: float, repeats: int, seed: int, size, keep: tuple) -> DataFrame:
    """The packets of `mix`, with their document's number in the queue (skey, part, rn)."""
    sized = df.select("doc_id", *keep, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "source", (size if size is not None else n_words(F.col("text"))).alias("size"), shuffled(seed, F.col("doc_id")).alias("h"))
    sized = stage(sized, "mix-sizes")
    n = sized.count()
    bits = max(ORDER_BITS[0], min(ORDER_BITS[1], (n // BUCKET_ROWS).bit_length()))
    slots = max(TIME_BUCKETS[0], min(TIME_BUCKETS[1], n // BUCKET_ROWS))
    sized = sized.withColumn("part", F.shiftright("h", HASH_BITS - bits).cast("int"))
    parts = sized.groupBy("skey", "source", "part").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    aims = stage(targets(parts, weights, budget, repeats), "mix-targets")
    base = parts.select("skey", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")).join(aims, "skey")
    queue = Window.partitionBy("skey", "part").orderBy("h", "doc_id", "size", *keep)
    queued = (
        sized.withColumn("rn", F.row_number().over(queue)).withColumn("end", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(base, ["skey", "part"]).withColumn("end", F.col("base") + F.col("end")).drop("base", "source")
    )

    def units(turn: int):
        start = F.col("end") - F.col("size") + turn * F.col("source_size")
        unit = lambda words, finish: F.struct(F.lit(turn).alias("turn"), words.cast("long").alias("words"), finish.cast("double").alias("finish"))
        whole = F.array(unit(F.col("size"), F.try_divide(start + F.col("size"), F.col("target"))))
        words = F.sequence(F.lit(1).cast("long"), F.least(F.col("size"), F.floor("target") - start + 1))
        split = F.transform(words, lambda j: unit(F.lit(1), F.try_divide(start + j, F.col("target"))))
        beyond = F.array(unit(F.lit(0), F.lit(None))) if turn == 0 else F.array().cast("array<struct<turn:int,words:bigint,finish:double>>")
        return F.when((F.col("size") == 0) | (start > F.col("target")), beyond).when(start + F.col("size") <= F.col("target"), whole).otherwise(split)

    timed = queued.withColumn("u", F.explode(F.flatten(F.array(*map(units, range(repeats)))))).select("*", "u.*").drop("u", "end")
    slot = F.when(F.col("words") > 0, F.least(F.lit(slots), F.floor(F.col("finish") * slots))).otherwise(slots + 1 + F.pmod("h", F.lit(slots)))
    timed = stage(timed.withColumn("slot", slot.cast("int")), "mix-units")
    sums = timed.groupBy("slot").agg(F.sum("words").alias("words"))  # at most 2 * slots + 1 rows
    start = sums.select("slot", F.coalesce(F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("slot_start"))
    served = Window.partitionBy("slot").orderBy("finish", "h", "doc_id", "turn", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget_words = F.lit(int(min(budget, repeats) * (aims.agg(F.sum("source_size")).first()[0] or 0)))
    done = timed.withColumn("done", F.sum("words").over(served)).join(F.broadcast(start), "slot").withColumn("before", F.col("slot_start") + F.col("done") - F.col("words"))
    done = done.withColumn("split", (F.col("words") > 0) & (F.col("words") < F.col("size"))).withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("words", budget_words - F.col("before"))))
    done = done.withColumn("mix_end", F.when(F.col("words") > 0, F.col("before") + F.col("words")))
    cols = ["skey", "part", "rn", "doc_id", *keep, "size", "source_size", "target", "turn", "words", "finish", "mix_end"]
    again = done.filter("split").groupBy(*cols[:-3]).agg(F.sum("words").alias("words"), F.max(F.when(F.col("words") > 0, F.col("finish"))).alias("finish"), F.max("mix_end").alias("mix_end"))
    return done.filter("NOT split").select(*cols).unionByName(again.select(*cols))


def mix(df: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, repeats: int = 2, seed: int = 11, size=None, keep: tuple = ()) -> DataFrame:
    """The mix's packets: every document's first turn, and each later turn that it gets.

    doc_id, *keep, size, source_size, target, turn (from 0), words (of this turn in the mix), finish
    (virtual), mix_end (words of the mix up to the packet's last; null if it has none).

    Weighted fair queueing: a source's documents queue up in a keyed shuffled order, the whole queue
    `repeats` times; a packet's virtual finish time is the source's words up to its end divided by
    the source's target. Packets are range-sorted by it over all sources, and the mix is the words of
    that order up to the budget. A document in which virtual time 1 falls, one a source at most and
    turn, queues word by word, so that the cut leaves each source within a word or two of its target.
    What starts later than virtual time 1 lies beyond the budget, which the targets add up to.

    The running sums are two-level: sums within buckets (of the shuffled order; of virtual time,
    which by design passes evenly over the words), plus sums of the buckets before. The buckets'
    number grows with the documents'.

    Null text: size 0, never taken. Null sources are one source, the last. Repeated rows queue like
    others; ties in the shuffled order go by id, then size. Empty table: no rows.
    """
    return _packets(df, weights, budget, repeats, seed, size, keep).drop("skey", "part", "rn")


def mixed_documents(df: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, repeats: int = 2, seed: int = 11, size=None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of df: its words in `mix`, repeats counted."""
    made = _packets(df, weights, budget, repeats, seed, size, ())
    return made.groupBy("skey", "part", "rn", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken")).drop("skey", "part", "rn")


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS skey, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         coalesce(('0x' || substr(md5('11|' || doc_id), 1, 15))::BIGINT, 0) AS h FROM documents),
t0 AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY skey, source),
t1 AS (SELECT *, ([{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}])[((i - 1) % {len(WEIGHTS)} + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM t0),
t2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
              sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM t1),
t3 AS (SELECT *, (budget - capped) / remaining AS level FROM t2),
lv AS (SELECT max(level) AS level FROM (SELECT level FROM t3 WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1)),
t AS (SELECT skey, source_size, least(cap, coalesce(lv.level * w, cap)) AS target FROM t3, lv),
q AS (SELECT d.*, source_size, target, row_number() OVER (ORDER BY h, doc_id, size) AS rid,
             (sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start FROM d JOIN t USING (skey)),
p AS (SELECT *, turn * source_size + start AS a FROM q, range(2) r(turn) WHERE size > 0 AND turn * source_size + start <= target),
u AS (SELECT rid, h, doc_id, turn, size, size AS words, (a + size) / target AS finish FROM p WHERE a + size <= target
      UNION ALL SELECT rid, h, doc_id, turn, size, 1, (a + j) / target FROM (SELECT *, unnest(range(1, least(size, floor(target)::BIGINT - a + 1) + 1)) AS j FROM p WHERE a + size > target)),
o AS (SELECT *, (sum(words) OVER (ORDER BY finish, h, doc_id, turn, size, rid ROWS UNBOUNDED PRECEDING))::BIGINT - words AS before FROM u),
g AS (SELECT rid, sum(greatest(0, least(words, (SELECT floor(1.5 * sum(source_size))::BIGINT FROM t) - before)))::BIGINT AS taken FROM o GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN g USING (rid)
"""
