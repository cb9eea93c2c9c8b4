"""SimHash near-duplicates: pigeonring candidate filter and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import stage, text_hash

#: A ring of five segments of the 64 bits: with at most 4 differing bits, some run of segments has
#: 0, <= 1, <= 2, <= 3 differing bits over its first 1, 2, 3, 4 segments (4 / 5 a segment).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BITS = 4
#: Rows that a task compares with each other; larger groups are compared block by block.
BLOCK = 4096


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased: bytes know no other letters and no white space
    but the six ASCII characters."""
    return (text or "").encode().lower().split()


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash, unsigned: a bit is 1 if set in over half of the shingles' hashes."""
    words = lower_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    set_ = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for a in range(0, n, 16384):  # bounded memory for texts of any length
        part = b"".join([digest(b" ".join(words[k : k + shingle]), 42) for k in range(a, min(n, a + 16384))])
        set_ += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), dtype=np.uint64, count=batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(made)], names=["doc_id", "th", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """doc_id, th (hash of the text), fp: the fingerprint of every whole text, as a signed long."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType())])
    return df.select(F.col(id_col).alias("doc_id"), text_hash().alias("th"), "text").mapInArrow(_fingerprints(shingle), schema)


def _keys(batches):
    """fp -> its ring keys (start, segment, next segment), also with each single set bit of the next
    segment cleared, since that one may differ by a bit. The keys' space is that of 26 bits for each
    start, so groups stay small for billions of fingerprints."""
    for batch in batches:
        fp = batch["fp"].to_numpy().view(np.uint64)
        fps, keys = [], []
        for i, (at, width) in enumerate(SEGMENTS):
            head = ((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)) | np.uint64(i << 13)
            at2, width2 = SEGMENTS[(i + 1) % len(SEGMENTS)]
            tail = (fp >> np.uint64(at2)) & np.uint64((1 << width2) - 1)
            fps.append(fp)
            keys.append((head << np.uint64(13)) | tail)
            for b in range(width2):
                on = (tail >> np.uint64(b)) & np.uint64(1) == 1
                fps.append(fp[on])
                keys.append((head[on] << np.uint64(13)) | (tail[on] ^ np.uint64(1 << b)))
        fp, key = np.concatenate(fps).view(np.int64), np.concatenate(keys).view(np.int64)
        for a in range(0, len(fp), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a : a + 65536]), pa.array(key[a : a + 65536])], names=["fp", "key"])


def _chain(start: int) -> list[np.uint64]:
    """Masks of the first 2, 3, 4 segments from `start` on around the ring, and of all bits."""
    masks, m = [], 0
    for k in range(len(SEGMENTS) - 1):
        at, width = SEGMENTS[(start + k) % len(SEGMENTS)]
        m |= ((1 << width) - 1) << at
        masks.append(np.uint64(m))
    return masks[1:] + [np.uint64(2**64 - 1)]


def near(fp: np.uint64, others: np.ndarray, chain: list[np.uint64]) -> np.ndarray:
    """Places of the others that the chain's budgets (1, 2, 3) leave and whose full distance is at
    most BITS; each test sees only what the one before has left."""
    at = np.arange(len(others))
    for budget, mask in enumerate(chain, 1):
        at = at[np.bitwise_count((others[at] ^ fp) & mask) <= budget]
        if not len(at):
            break
    return at


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one group; never more than its rows.

    Breadth first: a row is taken out of the open ones when reached, so a dense group costs about
    one comparison a row and no pair of it is written out. Rows that meet because each has another
    bit cleared fail the chain's budget; if they link, they do so in another group.
    """
    chain = _chain(start)
    edges, open_ = [], fps
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            hit = near(x, open_, chain)
            if len(hit):
                edges += [(int(x), int(y)) for y in open_[hit]]
                queue += list(open_[hit])
                open_ = np.delete(open_, hit)
    return edges


def _links(batches):
    """Rows (key, pair, fp), sorted: groups in turn, joined over batch ends -> edges of their forests."""

    def edges_of(key, fps):
        fps = np.unique(fps.view(np.uint64))
        return forest(fps, int(key) >> 26)

    held_key, held = None, []
    for batch in batches:
        key, pair, fp = (batch[c].to_numpy() for c in ("key", "pair", "fp"))
        if not len(key):
            continue
        cut = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        first, out = (key[0], pair[0]), []
        bounds = [0, *cut.tolist(), len(key)]
        for a, b in zip(bounds, bounds[1:]):
            if (a == 0 and first != held_key) or a:
                if sum(map(len, held)) > 1:
                    out += edges_of(held_key[0], np.concatenate(held))
                held_key, held = (key[a], pair[a]), []
            held.append(fp[a:b])
        if out:
            yield _edges(out)
    if sum(map(len, held)) > 1 and (out := edges_of(held_key[0], np.concatenate(held))):
        yield _edges(out)


def _edges(pairs) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between different fingerprints at BITS or fewer differing bits that connect all
    that is linked; of each group a spanning forest, not all its pairs.

    Two fingerprints that link share a ring key and pass its chain's budgets (the pigeonring
    principle), so they meet in a group. A ball of linked fingerprints is finite whatever the input,
    and other groups are shares of the 26-bit key space.
    Groups of over `block` rows are split into blocks by hash, and each pair of blocks is a group of
    its own: no task holds more than two blocks, and no pair of rows is left out.
    """
    keyed = distinct.select("fp").mapInArrow(_keys, "fp long, key long")
    keyed = stage(keyed, "ring-keys")
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-ring-keys")  # most keys have one row, and nobody to meet
    blocked = keyed.join(shared.withColumn("blocks", F.when(F.col("n") > block, F.ceil(F.col("n") / block)).cast("int")), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a pair of blocks (x <= y) is x * blocks + y; a lone group is -1
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o)))
    dealt = blocked.select("key", F.explode(pairs).alias("pair"), "fp")
    parts = dealt.repartition(F.col("key"), F.col("pair")).sortWithinPartitions("key", "pair")
    return parts.select("key", "pair", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", shingle: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, th, fp, component_id of every row of df: rows whose fingerprints differ in at most BITS
    bits link, and component_id is the smallest id reachable.

    Equal fingerprints are one node from the start, so copies of any number cost one row. Null,
    empty and wordless texts have fingerprint 0 and link like others; repeated rows and ids each
    keep their row; null ids are never the smallest unless all of a component are null. An empty
    table gives no rows. Other columns are ignored.
    """
    made = stage(fingerprints(df, id_col, shingle), "fingerprints")
    distinct = stage(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = stage(components(links(distinct, block)), "roots")
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = stage(joined.select("fp", "root", "least"), "rooted")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ids.join(least, "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", "th", "fp", "component_id")
