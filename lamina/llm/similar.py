"""Near-duplicates of a given similarity: SimHash links and prefix-filtered ones, compared as whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import Kept, one_each, stage, text_hash
from .neardup import _edges, links, lower_words

#: Least similarity of a link, as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
SHINGLE = 5
#: Bits of a set's parity bitmap, least and most; in between the power of two of 2 to 4 an element.
BITMAP = (512, 1 << 18)
#: Rows of a block of a large group when candidates are sought, elements of one when sets are compared.
BLOCK, ELEMENTS = 4096, 1 << 22
#: Rounds in which each component of candidates is compared with one of its sets; what they leave open
#: is compared in blocks. Bytes of such sets that are broadcast; more are joined.
SEEDS, SEED_BYTES = 8, 32 << 20
#: Bits of the table that tells which keys may be shared; a constant.
SHARED_BITS = 28
#: Bits of the table of how common shingles are, least and most.
COMMON_BITS = (16, 20)
#: Words whose hashes a worker keeps before it starts afresh.
CACHED_WORDS = 1 << 19
#: Rows whose sets are held at once, of a batch of texts; Spark's batches have 10,000.
ROWS = 1024
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _WordHashes(Kept):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word, 42)
        return got


_HASHES = _WordHashes()


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all shingles of a text's lower-cased words, repeats included; a text of fewer
    words is one shingle. A shingle's hash is mixed from those of its words, in their order."""
    words = lower_words(text)
    own = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.full(n, min(len(words), shingle), dtype=np.uint64)
    for k in range(min(shingle, len(words))):
        out = (out ^ own[k : k + n]) * np.uint64(_MIX[0])
        out ^= out >> np.uint64(29)
    for m in _MIX[1:]:
        out = (out ^ (out >> np.uint64(30))) * np.uint64(m)
    return out ^ (out >> np.uint64(31))


def _texts(batches):
    """Batches of texts in parts of ROWS; the worker now keeps the hashes of words only."""
    _HASHES.begin()
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def simhash(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes, unsigned."""
    n, set_ = len(hashes), np.zeros(64, dtype=np.int64)
    for a in range(0, n, 16384):
        set_ += np.unpackbits(hashes[a : a + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > n).tobytes(), "big")


def prefix(n: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """First elements of a set of n of which similar sets, in the same order, share one."""
    a, b = similarity
    return n + a * n // -b + 1


def bitmap(own: np.ndarray) -> bytes:
    """Parity of the number of elements at each of the bitmap's places: the bitmaps of two sets differ
    in no more bits than the sets differ in elements. Two widths meet at the smaller one, to which the
    larger folds."""
    width = min(BITMAP[1], max(BITMAP[0], 1 << (2 * len(own)).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (a row each) at half their width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def _counts(shingle: int, bits: int):
    """Texts -> (place, n): how many of the task's sets have an element of each hash place."""

    def run(batches):
        n, held, room = np.zeros(1 << bits, dtype=np.int64), [], 1 << 20
        for batch in _texts(batches):
            for text in batch["text"]:
                held.append((np.unique(shingle_hashes(text.as_py(), shingle)) >> np.uint64(64 - bits)).astype(np.int64))
                room -= len(held[-1])
                if room < 0:
                    n += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, room = [], 1 << 20
        n += np.bincount(np.concatenate(held), minlength=1 << bits) if held else 0
        at = np.flatnonzero(n)
        for a in range(0, len(at), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 65536]), pa.array(n[at[a : a + 65536]])], names=["place", "n"])

    return run


def common_shingles(docs: DataFrame, shingle: int = SHINGLE):
    """A broadcast table, a byte for each of 2**16 to 2**20 hash places: the bits of the number of sets
    that have an element there. Elements are sorted by it and then by hash, so the first ones of a set
    are rare, and passages that many texts share bring no strangers together."""
    n = docs.count()
    bits = max(COMMON_BITS[0], min(COMMON_BITS[1], n.bit_length() - 4))
    rows = docs.select("text").mapInArrow(_counts(shingle, bits), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(1 << bits, dtype=np.uint8)
    for r in rows:
        table[r["place"]] = r["n"].bit_length()
    return docs.sparkSession.sparkContext.broadcast(table)


def _sketches(shingle: int, similarity: tuple[int, int], common):
    def run(batches):
        table = common.value
        shift = np.uint64(65 - len(table).bit_length())
        for batch in _texts(batches):
            nodes, sizes, prints, bits, firsts = [], [], [], [], []
            for text in batch["text"]:
                every = shingle_hashes(text.as_py(), shingle)
                own = np.unique(every)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                sizes.append(len(own))
                prints.append(simhash(every))
                bits.append(bitmap(own))
                rare = np.argsort(table[own >> shift], kind="stable")[: prefix(len(own), similarity)]
                firsts.append(own[rare].view(np.int64))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            made = [signed(nodes), pa.array(sizes, pa.int32()), signed(prints), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *made], names=["doc_id", "th", "node", "n", "fp", "bits", "prefix"])

    return run


def _place(keys: np.ndarray) -> np.ndarray:
    return keys & np.int64((1 << SHARED_BITS) - 1)  # the low bits: the high ones tell how common a key is


def _maybe_shared(table):
    """Rows (node, prefix) -> (key, node) of the keys that the table does not rule out."""

    def run(batches):
        bits = np.frombuffer(table.value, dtype=np.uint8)
        for batch in batches:
            keys = batch["prefix"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            nodes = np.repeat(batch["node"].to_numpy(), batch["prefix"].value_lengths().to_numpy())
            at = _place(keys)
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            keys, nodes = keys[on], nodes[on]
            for a in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 65536]), pa.array(nodes[a : a + 65536])], names=["key", "node"])

    return run


def _shared_table(nodes: DataFrame):
    """A broadcast bitmap of 2**SHARED_BITS bits, 32 MB: the hash places where two sets have a key, or
    one has two. Most keys are in one set only, and go no further."""
    place = F.col("key").bitwiseAND(F.lit((1 << SHARED_BITS) - 1).cast("long"))
    shared = nodes.select(F.explode("prefix").alias("key")).select(place.cast("int").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    at = F.col("p").cast("long") + 1  # Spark's bitmaps count from 1
    rows = shared.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()  # 2**SHARED_BITS / 32768 rows
    table = bytearray(1 << (SHARED_BITS - 3))
    for r in rows:
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return nodes.sparkSession.sparkContext.broadcast(bytes(table))


def _sets(shingle: int):
    def run(batches):
        for batch in _texts(batches):
            made = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["root"], batch["node"], pa.array(made, pa.list_(pa.int64()))], names=["root", "node", "own"])

    return run


def _groups(batches):
    """Rows sorted by their first two columns -> the table of each group, joined over batch ends."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
        for a, b in zip(cut, cut[1:]):
            if held and last != (x[a], y[a]):
                yield pa.Table.from_batches(held)
                held = []
            last = (x[a], y[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def forest(nodes: np.ndarray, hits) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in a group; hits(i, places): those of the places that
    link with i. Breadth first, so no pair of a dense group is written out."""
    edges, open_ = [], np.arange(len(nodes))
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            on = hits(i, open_)
            if on.any():
                edges += [(nodes[i], nodes[j]) for j in open_[on]]
                queue += list(open_[on])
                open_ = open_[~on]
    return edges


def _flushed(found):
    """Lists of edges -> batches of them."""
    out = []
    for pairs in found:
        out += pairs
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _candidates(similarity: tuple[int, int]):
    """Rows (key, pair, node, n, bits) -> forests of the pairs that may be similar: sizes and bitmaps
    leave them."""
    a, b = similarity

    def one(group):
        nodes, n = group["node"].to_numpy().view(np.uint64), group["n"].to_numpy().astype(np.int64)
        raw = group["bits"].to_pylist()
        width = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 8  # in words
        place, maps = np.zeros(len(raw), dtype=np.int64), {}
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            place[own] = np.arange(len(own))
            maps[w] = np.frombuffer(b"".join(raw[i] for i in own), dtype=np.uint64).reshape(len(own), w)
        halves = {w: _folded(m) for w, m in maps.items()}

        def hits(i, at):
            # sizes that may be similar are within a factor of 5 / 4, so widths within one of 2
            ok = b * np.minimum(n[at], n[i]) >= a * np.maximum(n[at], n[i])
            for w in (width[i] // 2, width[i], 2 * width[i]):
                of = np.flatnonzero(ok & (width[at] == w))
                if not len(of):
                    continue
                if w <= width[i]:
                    mine = (halves if w < width[i] else maps)[width[i]][place[i]]
                    theirs = maps[w]
                else:
                    mine, theirs = maps[width[i]][place[i]], halves[w]
                apart = np.bitwise_count(theirs[place[at[of]]] ^ mine).sum(axis=1, dtype=np.int64)
                ok[of] = (a + b) * apart <= (b - a) * (n[at[of]] + n[i])
            return ok

        return forest(nodes, hits)

    return lambda batches: _flushed(one(g) for g in _groups(batches) if g.num_rows > 1)


def _verified(similarity: tuple[int, int]):
    """Rows (root, pair, node, own) -> forests of the pairs whose sets are similar."""
    a_, b_ = similarity

    def one(group):
        nodes, own = group["node"].to_numpy().view(np.uint64), group["own"].combine_chunks()
        n = own.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(n) - n
        _, flat = np.unique(own.flatten().to_numpy(), return_inverse=True)
        # who has each element: sets in the order of elements, and where each element's begin
        order = np.argsort(flat, kind="stable")
        holders, begins = np.repeat(np.arange(len(n)), n)[order], np.searchsorted(flat[order], np.arange(flat.max() + 2))

        def hits(i, at):
            mine = flat[starts[i] : starts[i] + n[i]]
            both = np.zeros(len(n), dtype=np.int64)
            for a in range(0, len(mine), 4096):
                sizes = begins[mine[a : a + 4096] + 1] - begins[mine[a : a + 4096]]
                runs = np.repeat(begins[mine[a : a + 4096]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                both += np.bincount(holders[runs], minlength=len(n))
            return (a_ + b_) * both[at] >= a_ * (n[at] + n[i])

        return forest(nodes, hits)

    return lambda batches: _flushed(one(g) for g in _groups(batches) if g.num_rows > 1)


def _dealt(rows: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """rows (key, node) with `pair`, for the groups of `sizes` (key, total): groups of over `block` come
    as pairs of blocks, so that no task holds more than two blocks and no pair is left out."""
    blocks = F.ceil(F.col("total") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(own, o) * blocks + F.greatest(own, o))
    return rows.join(sizes, key).select(key, F.explode(pairs).alias("pair"), "node")


def _similar_links(own: DataFrame, state: DataFrame, similarity: tuple[int, int], elements: int, seeds: int) -> DataFrame:
    """a, b: links that connect all similar sets of each root. own: root, node, own; state: root, node, n.

    In a round, one set of each root meets all the root's sets; those similar to it are linked, and
    join the root's main class if one of them is in it, or become it if they are more. A round reads the sets once and moves one a
    root. Sets outside of the main class after the last round are compared in blocks with each other
    and with the main class, so that no pair of different classes is left out.
    """
    a, b = similarity
    rounds, state = [], state.withColumn("main", F.lit(False)).withColumn("used", F.lit(False))
    for r in range(seeds):
        seed = stage(state.filter("NOT main AND NOT used").groupBy("root").agg(F.min(F.struct("node", "n")).alias("s")).select("root", F.col("s.node").alias("seed"), F.col("s.n").alias("m")), "seeds")
        size = seed.agg(F.sum("m")).first()[0]
        if not size:
            break
        sets = own.join(seed, (own["root"] == seed["root"]) & (own["node"] == seed["seed"])).select(seed["root"], "seed", F.col("own").alias("theirs"))
        sets = F.broadcast(sets) if 8 * size <= SEED_BYTES else sets
        both, total = F.size(F.array_intersect("own", "theirs")), F.size("own") + F.size("theirs")
        hit = stage(own.join(sets, "root").filter((a + b) * both >= a * total).select("root", "seed", "node"), "seed-links")
        rounds.append(hit.select(F.col("seed").alias("a"), F.col("node").alias("b")))
        met = state.join(hit.select("root", "node", F.lit(True).alias("hit")).distinct(), ["root", "node"], "left").join(seed.select("root", "seed"), "root", "left")
        hits, mains = F.count("hit"), F.count(F.when(F.col("main"), 1))
        way = F.when(F.max(F.col("hit") & F.col("main")), "joins").when(hits > mains, "is larger").otherwise("stays out")
        met = met.join(met.groupBy("root").agg(way.alias("way")), "root")
        met = met.withColumn("main", F.when(F.col("way") == "joins", F.col("main") | F.col("hit").isNotNull()).when(F.col("way") == "is larger", F.col("hit").isNotNull()).otherwise(F.col("main")))
        state = stage(met.withColumn("used", F.col("used") | F.coalesce(F.col("node") == F.col("seed"), F.lit(False))).select("root", "node", "n", "main", "used"), "seed-state")
    rest, whole = F.sum(F.when(~F.col("main"), F.col("n"))), F.sum(F.when(F.col("main"), F.col("n")))
    sizes = state.groupBy("root").agg(rest.alias("rest"), whole.alias("whole")).filter("rest > 0")
    sizes = sizes.select("root", F.ceil(F.col("rest") / elements).alias("i_n"), F.ceil(F.coalesce("whole", F.lit(0)) / elements).alias("j_n"))
    i, j = F.pmod(F.xxhash64("node"), F.col("i_n")), F.pmod(F.xxhash64("node"), F.greatest("j_n", F.lit(1)))
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    among = F.transform(each(F.col("i_n")), lambda o: F.least(i, o) * F.col("i_n") + F.greatest(i, o))
    across = F.col("i_n") * F.col("i_n")  # the first number of the pairs with the main class's blocks
    with_main = F.when(F.col("j_n") > 0, F.transform(each(F.greatest("j_n", F.lit(1))), lambda o: across + i * F.col("j_n") + o)).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(F.col("main"), F.transform(each(F.col("i_n")), lambda o: across + o * F.col("j_n") + j)).otherwise(F.concat(among, with_main))
    dealt = state.join(sizes, "root").select("root", F.explode(pairs).alias("pair"), "node")
    dealt = dealt.join(own.select("node", "own"), "node").select("root", "pair", "node", "own").repartition("root", "pair").sortWithinPartitions("root", "pair")
    out = dealt.mapInArrow(_verified(similarity), "a long, b long")
    for x in rounds:
        out = out.unionByName(x)
    return out


def similar_documents(df: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK, elements: int = ELEMENTS, seeds: int = SEEDS) -> DataFrame:
    """doc_id, th, component_id, root of every row of df: rows link if the sets of their words' shingles
    have at least this Jaccard similarity, and component_id is the smallest id reachable. root tells
    components apart, also those whose ids are all null.

    Candidates come from SimHash, whose links the pigeonring filter finds, and, as fingerprints of
    such sets may be farther apart than any filter reaches, from the prefix filter: similar sets share
    one of their least hashes and differ in few bits of their bitmaps. Candidates of one component are
    compared as whole sets, see `_similar_links`. No link is lost and none is made by chance (but for equal 64-bit hashes).
    Equal sets are one node from the start.

    Null, empty and wordless texts have equal sets; texts of fewer words than a shingle are one
    shingle. Repeated rows and ids each keep their row; null ids are never the smallest unless all of
    a component are null. An empty table gives no rows. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), text_hash().alias("th"), "text")
    kinds = (("th", T.LongType()), ("node", T.LongType()), ("n", T.IntegerType()), ("fp", T.LongType()), ("bits", T.BinaryType()), ("prefix", T.ArrayType(T.LongType())))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)])
    made = stage(docs.mapInArrow(_sketches(shingle, similarity, common_shingles(docs, shingle)), schema), "shingle-sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix")]
    nodes = stage(made.groupBy("node").agg(F.min("doc_id").alias("least"), *firsts), "shingle-sets")

    prints = stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    near = links(prints).join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.join(prints, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))

    keyed = stage(nodes.select("node", "prefix").mapInArrow(_maybe_shared(_shared_table(nodes)), "key long, node long"), "maybe-shared")
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("total")).filter("total > 1"), "shared-keys")
    met = _dealt(keyed, "key", shared, block).join(nodes.select("node", "n", "bits"), "node").select("key", "pair", "node", "n", "bits")
    met = met.repartition("key", "pair").sortWithinPartitions("key", "pair")
    alike = met.mapInArrow(_candidates(similarity), "a long, b long")
    maybe = stage(components(alike.unionByName(near).unionByName(same)), "candidates")

    held = made.select("doc_id", "th", "node", "n").join(maybe, "node").groupBy("node", "root", "n").agg(F.min(F.struct("doc_id", "th")).alias("d"))
    held = stage(held.select("node", "root", "n", F.col("d.doc_id").alias("__id"), F.col("d.th").alias("__th")), "candidates-held")
    texts = one_each(docs, made).join(held, (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("root", "node", "text")
    own = stage(texts.mapInArrow(_sets(shingle), "root long, node long, own array<long>"), "candidate-sets")
    roots = stage(components(_similar_links(own, held.select("root", "node", "n"), similarity, elements, seeds)), "similar-roots")

    ids = stage(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-rooted")
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return made.select("doc_id", "th", "node").join(named, "node").select("doc_id", "th", "component_id", "root")
