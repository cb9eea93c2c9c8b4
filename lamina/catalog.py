"""The registered queries of the dedup engine and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ship
from .functions.gear import gear_sql
from .operators import chunking, cluster, report, sketch, store
from .operators.codecs import CODECS, block_indexes, edit_distances, triplet_indexes
from .plans.scrub import ScrubConfig, measure, scrub
from .sources.tables import document_streams, memory_streams, page_streams, stage, stage_by, table


def _raw():
    return F.encode("text", "utf-8")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, chunk_id, data."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.sha2(_raw(), 256).alias("chunk_id"), _raw().alias("data"))


def _units(spark, sf_dir) -> DataFrame:
    """Each different text once: chunk_id, ord (its first document), data."""
    ship(spark)
    return _docs(spark, sf_dir).groupBy("chunk_id").agg(F.min("doc_id").alias("ord"), F.first("data").alias("data"))


# -- exact dedup and store lookups ----------------------------------------------------------------


def exact_dup_groups(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.col("chunk_id").alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id"))


def top_dup_groups(spark, sf_dir):
    return exact_dup_groups(spark, sf_dir).filter("n > 1").orderBy(F.desc("n"), "sha256").limit(20).select("sha256", "n")


def dedup_ratio_by_source(spark, sf_dir):
    sizes = report.dedup_bytes(_docs(spark, sf_dir), ("source",))
    return sizes.withColumn("ratio", F.round(F.col("logical_bytes") / F.col("unique_bytes"), 6))


def _known(spark, sf_dir) -> DataFrame:
    """A store's view: the chunks of the labelled documents."""
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("chunk_id")


def known_chunks_semijoin(spark, sf_dir):
    return store.known_chunks(_docs(spark, sf_dir), _known(spark, sf_dir)).select("doc_id")


def new_chunks_antijoin(spark, sf_dir):
    return store.new_chunks(_docs(spark, sf_dir), _known(spark, sf_dir)).select("doc_id")


# -- sketches ----------------------------------------------------------------------------------


def byte_histogram(spark, sf_dir):
    return sketch.byte_histogram(_docs(spark, sf_dir), "doc_id", F.col("data"))


def pair_histogram(spark, sf_dir):
    return sketch.pair_histogram(_docs(spark, sf_dir), "doc_id", F.col("data"))


def spectrum_c(spark, sf_dir):
    return sketch.spectrum_c(byte_histogram(spark, sf_dir), "doc_id")


def spectrum_f(spark, sf_dir):
    return sketch.spectrum_f(byte_histogram(spark, sf_dir), "doc_id")


def spectrum_p(spark, sf_dir):
    return sketch.spectrum_p(pair_histogram(spark, sf_dir), "doc_id")


def spectral_native(spark, sf_dir):
    return sketch.spectral_native(_docs(spark, sf_dir), "doc_id", F.col("data"))


def spectral_sketch(spark, sf_dir):
    ship(spark)
    return sketch.sketches(_docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "data"), "spectral").withColumnRenamed("chunk_id", "doc_id")


def _gear(spark, sf_dir):
    ship(spark)
    return sketch.sketches(_docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "data"), "gear").withColumnRenamed("chunk_id", "doc_id")


def gear_samples(spark, sf_dir):
    return _gear(spark, sf_dir).select("doc_id", "n_samples")


def gear_samples_native(spark, sf_dir):
    return sketch.gear_samples_native(_docs(spark, sf_dir), "doc_id", F.col("data"))


def gear_features(spark, sf_dir):
    return _gear(spark, sf_dir).select("doc_id", F.posexplode("features").alias("pos", "value"))


def gear_features_native(spark, sf_dir):
    return sketch.gear_features_native(_docs(spark, sf_dir), "doc_id", F.col("data"))


def gear_superfeatures(spark, sf_dir):
    return _gear(spark, sf_dir).select("doc_id", F.posexplode("super_features").alias("pos", "value"))


# -- chunking ----------------------------------------------------------------------------------


def gear_cut_points(spark, sf_dir):
    return chunking.gear_cuts(_docs(spark, sf_dir), "doc_id", F.col("data"), 13)


def gear_chunks(spark, sf_dir):
    ship(spark)
    return chunking.gear_chunks(document_streams(spark, sf_dir), 8).select(F.col("stream_id").alias("doc_id"), "chunk_no", "offset", "length", "sha256")


def clamped_chunks(spark, sf_dir):
    """Pages in chunks of 256 to 4096 bytes, put together again."""
    ship(spark)
    made = chunking.clamped_chunks(page_streams(spark, sf_dir), 256, 1024, 4096)
    back = made.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", F.hex("data").alias("x"), "length"))).alias("p"))
    inner = F.filter("p", lambda p, i: (p["length"] > 4096) | ((p["length"] < 256) & (i < F.size("p") - 1)))
    data = F.unhex(F.array_join(F.transform("p", lambda p: p["x"]), ""))
    return back.select(F.col("stream_id").alias("page_id"), F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("n_bytes"), (F.size(inner) == 0).alias("in_bounds"))


def normalised_chunks(spark, sf_dir):
    """Pages in chunks of two thresholds, put together again; how the sizes are bounded."""
    ship(spark)
    made = stage(chunking.normalised_chunks(page_streams(spark, sf_dir), 256, 1024, 4096), "normalised")
    last = made.groupBy("stream_id").agg(F.max("chunk_no").alias("last"))
    sized = made.join(last, "stream_id").groupBy("stream_id").agg(F.min((F.col("length") <= 4096) & ((F.col("length") >= 256) | (F.col("chunk_no") == F.col("last")))).alias("in_bounds"), F.sum("length").alias("n_bytes"))
    back = store.joined(made)
    return sized.join(back, "stream_id").select(F.col("stream_id").alias("page_id"), F.sha2("data", 256).alias("sha256"), "n_bytes", "in_bounds")


# -- clusters ----------------------------------------------------------------------------------


def _spectral_units(spark, sf_dir) -> DataFrame:
    units = _units(spark, sf_dir)
    return stage(sketch.sketches(units, "spectral", keep=("chunk_id", "ord")), "spectral")


def eq_clusters(spark, sf_dir):
    """Documents of equal sketches: the first of each cluster and their number."""
    sketched = spectral_sketch(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), "sketch")
    return cluster.equal_clusters(sketched).groupBy("cluster_key").agg(F.min("ord").alias("first_doc_id"), F.count(F.lit(1)).alias("n")).drop("cluster_key")


def islands(spark, sf_dir):
    return cluster.islands(_spectral_units(spark, sf_dir))


def _led(spark, sf_dir) -> DataFrame:
    return stage(cluster.leader_clusters(_spectral_units(spark, sf_dir)), "led")


def leader_clusters(spark, sf_dir):
    return _led(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.col("cluster_key").alias("leader"))


def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(_led(spark, sf_dir)).select(F.col("cluster_key").alias("leader"), "size")


def member_distance(spark, sf_dir):
    near = cluster.member_distances(_led(spark, sf_dir).withColumn("chunk_id", F.col("ord")))
    return near.select(F.col("cluster_key").alias("leader"), F.col("chunk_id").alias("doc_id"), "distance")


def leader_distance(spark, sf_dir):
    return cluster.leader_distances(_led(spark, sf_dir))


def leader_distance_lists(spark, sf_dir):
    """Distances of every leader to every other."""
    return cluster.all_leader_distances(_led(spark, sf_dir)).select(F.col("a").alias("leader"), F.col("b").alias("other"), "distance")


def cluster_report(spark, sf_dir):
    return cluster.cluster_report(_led(spark, sf_dir))


def parent_choice(spark, sf_dir):
    chosen = store.parents(_led(spark, sf_dir))
    return chosen.select(F.col("ord").alias("doc_id"), F.col("cluster_key").alias("leader"), "is_parent")


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The store of the different texts under leader clusters, and the texts (chunk_id, ord, data)."""
    units = stage_by(_units(spark, sf_dir), "units", "chunk_id")
    return scrub(units, ScrubConfig("spectral", "leader")).store, units


def store_keys(spark, sf_dir):
    """Store keys of the different texts: leaders in full, deltas numbered from 0 in order."""
    kept, units = _stored(spark, sf_dir)
    return kept.join(units.select("chunk_id", "ord"), "chunk_id").select(F.col("ord").alias("doc_id"), F.col("cluster_key").cast("long").alias("leader"), "chunk_type", "number")


def store_get(spark, sf_dir):
    """Look-ups by key, decoded: those of the even documents, and of keys that are not there."""
    kept, units = _stored(spark, sf_dir)
    keys = kept.join(units.select("chunk_id", "ord"), "chunk_id").filter(F.col("ord") % 2 == 0)
    wanted = keys.select(*store.KEY).unionByName(keys.select("cluster_key", F.lit("delta").alias("chunk_type"), F.lit(-1).alias("number")).distinct())
    got = store.get(kept, wanted).withColumn("sha256", F.sha2("data", 256))
    return got.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("sha256").isNotNull(), F.col("n")))


def store_contains(spark, sf_dir):
    """How many keys of leaders and of first deltas the store has."""
    kept, _ = _stored(spark, sf_dir)
    keys = kept.select("cluster_key").distinct().select("cluster_key", F.explode(F.array(F.struct(F.lit("simple").alias("chunk_type"), F.lit(0).alias("number")), F.struct(F.lit("delta").alias("chunk_type"), F.lit(0).alias("number")))).alias("k"))
    return store.contains(kept, keys.select("cluster_key", "k.*")).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


def probed_cells(spark, sf_dir):
    """Free cells of a small table for the sketches of the different texts, some cells being taken; null
    where none of 4,000 candidates is free."""
    units = _spectral_units(spark, sf_dir).select("ord", (F.col("sketch") % 5000).alias("cell"))
    taken = table(spark, sf_dir, "labels").select((F.col("doc_id") * 7 % 5000).alias("cell"))
    return store.probe_cells(units, taken, 4999, 4000).select(F.col("ord").alias("doc_id"), "cell", F.col("at").alias("got"))


def store_insert(spark, sf_dir):
    """Leaders put in again with other data: their rows are replaced, the rest stays."""
    kept, _ = _stored(spark, sf_dir)
    again = kept.filter("role = 'leader'").withColumn("payload", F.encode(F.col("cluster_key"), "utf-8"))
    after = store.merged(kept, again)
    return after.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("payload") == F.encode("cluster_key", "utf-8"), 1)).alias("renewed"))


def _gear_units(spark, sf_dir) -> DataFrame:
    units = _units(spark, sf_dir)
    return stage(sketch.sketches(units, "gear", keep=("chunk_id", "ord")), "gear")


def similar_pairs(spark, sf_dir):
    """Pairs of different super-feature lists that share a value at a place, by first documents."""
    keys = _gear_units(spark, sf_dir).filter("super_features IS NOT NULL").groupBy(F.col("super_features").alias("features")).agg(F.min("ord").alias("key"))
    return cluster.similar_pairs(keys, 1)


def eq_partial_clusters(spark, sf_dir):
    made = stage(cluster.partial_clusters(_gear_units(spark, sf_dir)), "partial")
    first = made.groupBy("cluster_key").agg(F.min("ord").alias("leader"))
    return made.join(first, "cluster_key").select(F.col("ord").alias("doc_id"), "leader")


# -- codecs ------------------------------------------------------------------------------------


def adler_blocks(spark, sf_dir):
    """Sums of 16-byte blocks and how many places have each."""
    ship(spark)
    return block_indexes(_docs(spark, sf_dir).select("doc_id", "data")).withColumnRenamed("key", "hash")


def triplet_index(spark, sf_dir):
    """Three-byte keys and the number of their places, 1024 at most."""
    ship(spark)
    return triplet_indexes(_docs(spark, sf_dir).select("doc_id", "data"))


def edit_distance(spark, sf_dir):
    """Distance of each clustered document from its parent, in bytes."""
    units = stage_by(_units(spark, sf_dir), "units", "chunk_id")
    sketched = stage(sketch.sketches(units, "spectral", keep=("chunk_id", "ord")), "spectral")
    chosen = store.parents(stage(cluster.leader_clusters(sketched), "led")).join(units.select("chunk_id", "data"), "chunk_id")
    led = chosen.filter("is_parent").select("cluster_key", F.col("data").alias("a"))
    return edit_distances(chosen.filter("NOT is_parent").join(led, "cluster_key").select(F.col("ord").alias("doc_id"), "a", F.col("data").alias("b")))


def delta_sizes(spark, sf_dir):
    """Deltas of every text of 200 bytes or more against itself with ten bytes overwritten, by the codecs
    that find matches of any place: none may take over 100 bytes and a quarter of the text."""
    ship(spark)
    units = stage(_units(spark, sf_dir).filter(F.octet_length("data") >= 200), "units")
    edited = F.concat(F.expr("substring(data, 1, 100)"), F.lit(b"##########"), F.expr("substring(data, 111)"))
    out = None
    for name in ("gdelta", "xdelta", "edit", "gdelta_zstd"):
        made = store.coded(units.select("ord", F.octet_length("data").alias("n"), F.lit(name).alias("codec"), F.col("data").alias("parent"), edited.alias("data")), "encode")
        own = made.select(F.col("ord").alias("doc_id"), F.lit(name).alias("codec"), (F.octet_length("made") <= 100 + F.col("n") / 4).alias("small"))
        out = own if out is None else out.unionByName(own)
    return out


def piece_index(spark, sf_dir):
    """Content-defined pieces of each document and their first places."""
    made = gear_chunks(spark, sf_dir)
    return made.groupBy("doc_id", "sha256").agg(F.min("offset").alias("first_offset"))


def ddelta_plan(spark, sf_dir):
    """Operations that rebuild each clustered document from its parent's pieces, by joins."""
    chosen = store.parents(_led(spark, sf_dir)).withColumnRenamed("cluster_key", "leader")
    pieces = gear_chunks(spark, sf_dir)
    parent = chosen.filter("is_parent").select("leader", F.col("ord").alias("parent_id"))
    index = pieces.groupBy(F.col("doc_id").alias("parent_id"), "sha256").agg(F.min("offset").alias("at"))
    members = chosen.filter("NOT is_parent").select("leader", F.col("ord").alias("doc_id")).join(parent, "leader")
    plan = members.join(pieces, "doc_id").join(index, ["parent_id", "sha256"], "left")
    return plan.select("doc_id", F.col("chunk_no").alias("piece_no"), F.when(F.col("at").isNull(), "insert").otherwise("copy").alias("op"), F.col("at").alias("parent_offset"), "length")


def _checked(back: DataFrame) -> DataFrame:
    """chunk_id, got, n_bytes: digest and length of data that came back. A chunk's id is its digest, so
    the two are compared without moving the data."""
    return back.select("chunk_id", F.sha2("data", 256).alias("got"), F.octet_length("data").cast("long").alias("n_bytes"))


def _roundtrip(spark, sf_dir, name: str):
    """Every different text through cluster, delta and decode."""
    units = stage_by(_units(spark, sf_dir), "units", "chunk_id")
    made = scrub(units, ScrubConfig(codec=name))
    back = _checked(store.decode(made.store, made.store))
    return units.select("chunk_id", "ord").join(back, "chunk_id", "left").select(F.col("ord").alias("doc_id"), F.col("chunk_id").eqNullSafe(F.col("got")).alias("ok"), "n_bytes")


def restore_documents(spark, sf_dir):
    """Documents in content-defined chunks, through the store and back."""
    ship(spark)
    streams = document_streams(spark, sf_dir)
    chunks = stage(chunking.gear_chunks(streams, 8), "chunks").withColumn("chunk_id", F.col("sha256"))
    made = scrub(stage_by(store.unique_chunks(chunks), "unique", "chunk_id"))
    back = store.restore(store.manifest(chunks, made.store), made.store).select("stream_id", F.sha2("data", 256).alias("sha256"))
    return streams.select("stream_id").join(back, "stream_id", "left").select(F.col("stream_id").alias("doc_id"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("sha256"))


def incremental_scrub(spark, sf_dir):
    """The labelled documents first, then the rest against their store: every text is stored once."""
    units = stage_by(_units(spark, sf_dir), "units", "chunk_id")
    first = scrub(units.join(stage(_known(spark, sf_dir).distinct(), "known"), "chunk_id", "left_semi"))
    second = scrub(units, existing=first.store)
    both = first.store.unionByName(second.store)
    back = _checked(store.decode(both, both))
    return units.select("chunk_id", "ord").join(back, "chunk_id", "left").select(F.col("ord").alias("doc_id"), F.col("chunk_id").eqNullSafe(F.col("got")).alias("ok"))


def scrub_report(spark, sf_dir):
    units = stage_by(_units(spark, sf_dir), "units", "chunk_id")
    logical = _docs(spark, sf_dir).agg(F.sum(F.octet_length("data"))).first()[0]
    return report.scrub_report(scrub(units).store, logical, units.agg(F.sum(F.octet_length("data"))).first()[0])


def scrub_counts(spark, sf_dir):
    """What of a scrub's report no codec decides: chunks, clusters, bytes and the ratio of exact dedup."""
    kept, units = _stored(spark, sf_dir)
    logical = _docs(spark, sf_dir).agg(F.sum(F.octet_length("data"))).first()[0]
    made = report.scrub_report(kept, logical, units.agg(F.sum(F.octet_length("data"))).first()[0])
    whole = made.withColumn("adds_up", (F.col("data_left") + F.col("target_bytes") == F.col("literal_bytes")) & (F.col("total_ratio") >= F.col("cdc_ratio")))
    return whole.select("clusters", "chunks", "logical_bytes", "literal_bytes", "cdc_ratio", "adds_up")


def measurement(spark, sf_dir):
    """The measurement program: 10 MiB of zeros in chunks of 16 to 64 KiB, scrubbed and read back."""
    ship(spark)
    zeros = memory_streams(spark, bytes(10 << 20))
    return measure(zeros, lambda s: chunking.clamped_chunks(s, 16 << 10, 32 << 10, 64 << 10)).select("cdc_dedup_ratio", "total_dedup_ratio")


def flagship(spark, sf_dir):
    return cluster_sizes(spark, sf_dir)


_PLAIN = (
    exact_dup_groups, top_dup_groups, dedup_ratio_by_source, known_chunks_semijoin, new_chunks_antijoin, byte_histogram, pair_histogram,
    spectrum_c, spectrum_f, spectrum_p, spectral_native, spectral_sketch, gear_samples, gear_samples_native, gear_features,
    gear_features_native, gear_superfeatures, gear_cut_points, gear_chunks, clamped_chunks, eq_clusters, islands, leader_clusters,
    cluster_sizes, member_distance, leader_distance, cluster_report, parent_choice, store_keys, similar_pairs, eq_partial_clusters,
    adler_blocks, triplet_index, piece_index, ddelta_plan, restore_documents, incremental_scrub, scrub_report, measurement,
    normalised_chunks, leader_distance_lists, store_get, store_contains, store_insert, edit_distance, delta_sizes, scrub_counts, probed_cells,
)


def queries() -> dict:
    return {f.__name__: f for f in _PLAIN} | {f"roundtrip_{name}": partial(_roundtrip, name=name) for name in CODECS}


# -- SQL ---------------------------------------------------------------------------------------

_BYTES = """
hx AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS hs FROM documents),
b0 AS (SELECT doc_id, unnest(hs) AS x, unnest(range(len(hs))) AS i FROM hx),
b AS (SELECT doc_id, i, ((strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1)::INT AS v FROM b0)"""
_HIST = _BYTES + """,
hist AS (SELECT doc_id, v, count(*)::BIGINT AS c FROM b GROUP BY ALL)"""
_PAIRS = _BYTES + """,
two AS (SELECT doc_id, v AS a, lead(v) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM b),
pairs AS (SELECT doc_id, a, b, count(*)::BIGINT AS c FROM two WHERE b IS NOT NULL GROUP BY ALL)"""
_C = """
c1 AS (SELECT doc_id, v, c, row_number() OVER w - 1 AS i, lead(c) OVER w AS d FROM hist WINDOW w AS (PARTITION BY doc_id ORDER BY c DESC, v)),
c2 AS (SELECT *, CASE WHEN c > d AND d >= 50 THEN (c - d) * (i + 1) END AS gap FROM c1),
c3 AS (SELECT *, gap IS NOT NULL AND row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC NULLS LAST, i) <= 8 AS kept FROM c2),
c4 AS (SELECT *, coalesce(sum(kept::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM c3),
c5 AS (SELECT doc_id, blk, bit_xor(v)::BIGINT AS x FROM c4 GROUP BY ALL HAVING max(kept::INT) = 1),
pc AS (SELECT doc_id, bit_xor((x << (3 * (8 - blk))::INT) & 4294967295)::BIGINT AS hash FROM c5 GROUP BY doc_id)"""
_F = """
f1 AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, v) AS i FROM hist),
pf AS (SELECT doc_id, bit_xor((((c * 8) >> (length(bin(c)) - 1)::INT) % 8) << [0,0,0,1,1,2,2,3,3,4,4,5,5,6,6,6][i])::BIGINT AS hash FROM f1 WHERE i <= 16 GROUP BY doc_id)"""
_P = """
p1 AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, a, b) AS i FROM pairs),
pp AS (SELECT doc_id, bit_xor(xor((((a * 8) % 256 + a // 32) * 16)::BIGINT, ((b // 8) + (b * 32) % 256)::BIGINT) * 1048576)::BIGINT AS hash FROM p1 WHERE i BETWEEN 6 AND 9 GROUP BY doc_id)"""
_SKETCH = _HIST + "," + _PAIRS.removeprefix(_BYTES + ",") + "," + _C + "," + _F + "," + _P + """,
sk AS (SELECT d.doc_id, xor(xor(coalesce(pc.hash, 0), coalesce(pf.hash, 0)), coalesce(pp.hash, 0))::BIGINT AS sketch
       FROM documents d LEFT JOIN pc USING (doc_id) LEFT JOIN pf USING (doc_id) LEFT JOIN pp USING (doc_id))"""
_LED = _SKETCH + """,
firsts AS (SELECT min(doc_id) AS ord FROM documents GROUP BY text),
seq AS MATERIALIZED (SELECT ord, sketch, row_number() OVER (ORDER BY ord) AS rn FROM firsts JOIN sk ON doc_id = ord),
st(rn, leaders, ord, sketch, leader) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT n.rn, CASE WHEN n.best IS NULL THEN list_append(n.leaders, n.sketch) ELSE n.leaders END, n.ord, n.sketch, coalesce(n.best, n.sketch)
  FROM (SELECT seq.rn, st.leaders, seq.ord, seq.sketch,
               list_sort(list_transform(list_filter(st.leaders, lambda x: abs(x - seq.sketch) <= 10), lambda x: {'d': abs(x - seq.sketch), 'x': x}))[1].x AS best
        FROM st JOIN seq ON seq.rn = st.rn + 1) n),
led AS (SELECT ord, sketch, leader FROM st WHERE rn > 0)"""


def _gear_sql(bits: int, window: int) -> str:
    out, last, w, k = f",\ng0 AS (SELECT doc_id, i, v, ({gear_sql(bits)})[v + 1]::BIGINT AS h FROM b)", "g0", 1, 0
    while w < window:
        k += 1
        out += f",\ng{k} AS (SELECT doc_id, i, v, (h + coalesce(lag(h, {w}) OVER (PARTITION BY doc_id ORDER BY i), 0) * {1 << w}) % {1 << bits} AS h FROM {last})"
        last, w = f"g{k}", 2 * w
    return out + f",\ng AS (SELECT * FROM {last})"


def _feature_sql() -> str:
    each = [f"min((((({c >> 16}) * h) % 65536) * 65536 + {c & 0xFFFF} * h + v) % 4294967296)::BIGINT" for c in sketch.coefficients(sketch.GROUPS * sketch.SUPERS)]
    return _BYTES + _gear_sql(32, 32) + f",\nft AS (SELECT doc_id, [{', '.join(each)}] AS f FROM g WHERE h % {1 << sketch.RATE} = 0 GROUP BY doc_id)"


def _super_sql() -> str:
    s = sketch.SUPERS
    runs = [f"list_sort(f[{g * s + 1}:{(g + 1) * s}])" for g in range(sketch.GROUPS)]
    joined = " || ',' || ".join(f"({r})[k]::VARCHAR" for r in runs)
    return _feature_sql() + f",\nsf AS (SELECT doc_id, k - 1 AS pos, sha256({joined}) AS value FROM ft, range(1, {s + 1}) t(k))"


def _pieces_sql(bits: int = 8) -> str:
    return _BYTES + _gear_sql(bits, 16) + f""",
cuts AS (SELECT doc_id, i AS a FROM g WHERE i = 0 OR h = {1 << (bits - 1)}),
ed AS (SELECT doc_id, a, row_number() OVER w - 1 AS chunk_no, coalesce(lead(a) OVER w, n) AS z
       FROM cuts JOIN (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
pieces AS (SELECT doc_id, chunk_no::INT AS chunk_no, a::BIGINT AS "offset", (z - a)::INT AS length, sha256(unhex(array_to_string(hs[a + 1 : z], ''))) AS sha256
           FROM ed JOIN hx USING (doc_id))"""


_EVERY = "SELECT min(doc_id) AS doc_id, true AS ok, octet_length(encode(text))::BIGINT AS n_bytes FROM documents GROUP BY text"


def oracle_sql() -> dict:
    sql = {
        "exact_dup_groups": "SELECT sha256(text) AS sha256, count(*)::BIGINT AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1",
        "top_dup_groups": "SELECT sha256(text) AS sha256, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, sha256 LIMIT 20",
        "dedup_ratio_by_source": "SELECT source, sum(l)::BIGINT AS logical_bytes, sum(u)::BIGINT AS unique_bytes, round(sum(l) / sum(u), 6) AS ratio FROM (SELECT source, sum(octet_length(encode(text))) AS l, any_value(octet_length(encode(text))) AS u FROM documents GROUP BY source, text) GROUP BY source",
        "known_chunks_semijoin": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id))",
        "new_chunks_antijoin": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))",
        "byte_histogram": f"WITH {_HIST} SELECT doc_id, v, c FROM hist",
        "pair_histogram": f"WITH {_PAIRS} SELECT doc_id, a, b, c FROM pairs",
        "spectrum_c": f"WITH {_HIST}, {_C} SELECT * FROM pc",
        "spectrum_f": f"WITH {_HIST}, {_F} SELECT * FROM pf",
        "spectrum_p": f"WITH {_PAIRS}, {_P} SELECT * FROM pp",
        "spectral_sketch": f"WITH {_SKETCH} SELECT doc_id, sketch FROM sk",
        "gear_samples": f"WITH {_BYTES}{_gear_sql(7, 8)}, n AS (SELECT doc_id, count(*) AS n FROM g WHERE h = 0 GROUP BY 1) SELECT doc_id, coalesce(n, 0)::BIGINT AS n_samples FROM documents LEFT JOIN n USING (doc_id)",
        "gear_features": f"WITH {_feature_sql()} SELECT doc_id, (k - 1)::INT AS pos, f[k] AS value FROM ft, range(1, {sketch.GROUPS * sketch.SUPERS + 1}) t(k)",
        "gear_superfeatures": f"WITH {_super_sql()} SELECT doc_id, pos::INT AS pos, value FROM sf",
        "gear_cut_points": f"WITH {_BYTES}{_gear_sql(13, 16)} SELECT doc_id, i::BIGINT AS cut FROM g WHERE h = 4096 AND i > 0",
        "gear_chunks": f"WITH {_pieces_sql()} SELECT * FROM pieces",
        "clamped_chunks": "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS n_bytes, true AS in_bounds FROM pages",
        "eq_clusters": f"WITH {_SKETCH} SELECT min(doc_id) AS first_doc_id, count(*)::BIGINT AS n FROM sk GROUP BY sketch",
        "normalised_chunks": "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS n_bytes, true AS in_bounds FROM pages",
        "leader_distance_lists": f"WITH RECURSIVE {_LED}, k AS (SELECT DISTINCT leader FROM led) SELECT x.leader, y.leader AS other, abs(x.leader - y.leader)::BIGINT AS distance FROM k x, k y WHERE x.leader <> y.leader",
        "store_get": f"WITH RECURSIVE {_LED} SELECT sha256(text) AS sha256, 1::BIGINT AS n FROM led JOIN documents ON doc_id = ord WHERE ord % 2 = 0 UNION ALL SELECT NULL, NULL",
        "store_contains": f"WITH RECURSIVE {_LED}, s AS (SELECT leader, count(*) AS n FROM led GROUP BY 1) SELECT 'simple' AS chunk_type, count(*)::BIGINT AS n FROM s HAVING count(*) > 0 UNION ALL SELECT 'delta', count(*)::BIGINT FROM s WHERE n > 1 HAVING count(*) > 0",
        "store_insert": f"WITH RECURSIVE {_LED}, p AS (SELECT ord = min(ord) OVER (PARTITION BY leader) AS leads FROM led) SELECT CASE WHEN leads THEN 'simple' ELSE 'delta' END AS chunk_type, count(*)::BIGINT AS n, count(*) FILTER (leads)::BIGINT AS renewed FROM p GROUP BY 1",
        "probed_cells": f"""WITH RECURSIVE {_SKETCH},
firsts AS (SELECT min(doc_id) AS ord FROM documents GROUP BY text),
seq AS MATERIALIZED (SELECT ord, sketch % 5000 AS cell, row_number() OVER (ORDER BY ord) AS rn FROM firsts JOIN sk ON doc_id = ord),
st(rn, used, ord, cell, got) AS (
  SELECT 0::BIGINT, (SELECT list(DISTINCT doc_id * 7 % 5000) FROM labels)::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT n.rn, list_append(n.used, n.got), n.ord, n.cell, n.got
  FROM (SELECT seq.rn, st.used, seq.ord, seq.cell,
               list_filter(list_transform(range(0, 4000), lambda k: seq.cell + CASE WHEN k % 2 = 1 THEN (k + 1) // 2 ELSE -(k // 2) END), lambda c: c >= 0 AND c <= 4999 AND NOT list_contains(st.used, c))[1] AS got
        FROM st JOIN seq ON seq.rn = st.rn + 1) n)
SELECT ord AS doc_id, cell::BIGINT AS cell, got FROM st WHERE rn > 0""",
        "edit_distance": f"WITH RECURSIVE {_LED}, p AS (SELECT ord, min(ord) OVER (PARTITION BY leader) AS parent FROM led) SELECT p.ord AS doc_id, levenshtein(a.text, b.text)::BIGINT AS distance FROM p JOIN documents a ON a.doc_id = parent JOIN documents b ON b.doc_id = ord WHERE ord <> parent",
        "delta_sizes": "SELECT min(doc_id) AS doc_id, codec, true AS small FROM documents, (VALUES ('gdelta'), ('xdelta'), ('edit'), ('gdelta_zstd')) c(codec) WHERE octet_length(encode(text)) >= 200 GROUP BY text, codec",
        "scrub_counts": f"WITH RECURSIVE {_LED}, d AS (SELECT any_value(octet_length(encode(text))) AS l, count(*) AS n FROM documents GROUP BY text) SELECT (SELECT count(DISTINCT leader) FROM led)::BIGINT AS clusters, count(*)::BIGINT AS chunks, sum(l * n)::BIGINT AS logical_bytes, sum(l)::BIGINT AS literal_bytes, round(sum(l * n) / sum(l), 6) AS cdc_ratio, true AS adds_up FROM d",
        "measurement": "WITH c AS (SELECT least(64 << 10, (10 << 20) - a) AS length FROM range(0, 10 << 20, 64 << 10) r(a)) SELECT (sum(length) / max(length))::DOUBLE AS cdc_dedup_ratio, (sum(length) / max(length))::DOUBLE AS total_dedup_ratio FROM c",
        "islands": f"WITH {_SKETCH}, k AS (SELECT DISTINCT sketch FROM sk), l AS (SELECT sketch, sketch - coalesce(lag(sketch) OVER (ORDER BY sketch), -100) > 10 AS head FROM k) SELECT sketch, max(CASE WHEN head THEN sketch END) OVER (ORDER BY sketch) AS island FROM l",
        "leader_clusters": f"WITH RECURSIVE {_LED} SELECT ord AS doc_id, leader FROM led",
        "cluster_sizes": f"WITH RECURSIVE {_LED} SELECT leader, count(*)::BIGINT AS size FROM led GROUP BY 1",
        "member_distance": f"WITH RECURSIVE {_LED} SELECT leader, ord AS doc_id, abs(sketch - leader)::BIGINT AS distance FROM led WHERE sketch <> leader",
        "leader_distance": f"WITH RECURSIVE {_LED}, k AS (SELECT DISTINCT leader FROM led) SELECT leader, leader - lag(leader) OVER (ORDER BY leader) AS below, lead(leader) OVER (ORDER BY leader) - leader AS above FROM k",
        "cluster_report": f"WITH RECURSIVE {_LED}, s AS (SELECT leader, count(*) AS size FROM led GROUP BY 1) SELECT sum(size)::BIGINT AS total, count(*)::BIGINT AS clusters, max(size)::BIGINT AS largest, count(*) FILTER (size = 1)::BIGINT AS singletons FROM s",
        "parent_choice": f"WITH RECURSIVE {_LED} SELECT ord AS doc_id, leader, ord = min(ord) OVER (PARTITION BY leader) AS is_parent FROM led",
        "store_keys": f"WITH RECURSIVE {_LED}, p AS (SELECT ord, leader, row_number() OVER (PARTITION BY leader ORDER BY ord) AS rn FROM led) SELECT ord AS doc_id, leader, CASE WHEN rn = 1 THEN 'simple' ELSE 'delta' END AS chunk_type, greatest(rn - 2, 0)::INT AS number FROM p",
        "similar_pairs": f"WITH {_super_sql()}, k AS (SELECT min(doc_id) AS key, f FROM (SELECT doc_id, list(value ORDER BY pos) AS f FROM sf GROUP BY doc_id) GROUP BY f) SELECT x.doc_id AS a, y.doc_id AS b, count(*)::BIGINT AS shared FROM sf x JOIN sf y ON x.pos = y.pos AND x.value = y.value AND x.doc_id < y.doc_id WHERE x.doc_id IN (SELECT key FROM k) AND y.doc_id IN (SELECT key FROM k) GROUP BY 1, 2",
        "eq_partial_clusters": f"""WITH RECURSIVE {_super_sql()},
fl AS (SELECT doc_id, list(value ORDER BY pos) AS f FROM sf GROUP BY doc_id),
ks AS MATERIALIZED (SELECT min(doc_id) AS ord, coalesce(f, []) AS f, row_number() OVER (ORDER BY min(doc_id)) AS rn FROM documents LEFT JOIN fl USING (doc_id) GROUP BY coalesce(f, [])),
st(rn, leaders, ord, leader) AS (
  SELECT 0::BIGINT, []::STRUCT(o BIGINT, f VARCHAR[])[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT n.rn, CASE WHEN n.best IS NULL THEN list_append(n.leaders, {{'o': n.ord, 'f': n.f}}) ELSE n.leaders END, n.ord, coalesce(n.best, n.ord)
  FROM (SELECT ks.rn, st.leaders, ks.ord, ks.f, list_filter(st.leaders, lambda x: (x.f[1] = ks.f[1] OR x.f[2] = ks.f[2] OR x.f[3] = ks.f[3] OR x.f[4] = ks.f[4] OR x.f[5] = ks.f[5] OR x.f[6] = ks.f[6]))[1].o AS best
        FROM st JOIN ks ON ks.rn = st.rn + 1) n)
SELECT u.doc_id, st.leader FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) u LEFT JOIN fl USING (doc_id) JOIN ks ON ks.f = coalesce(fl.f, []) JOIN st ON st.ord = ks.ord""",
        "adler_blocks": f"WITH {_BYTES}, s AS (SELECT doc_id, i, sum(v) OVER w AS s, sum(v * i) OVER w AS t, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) SELECT doc_id, (((16 + i) * s - t + 16) * 65536 + s + 1)::BIGINT AS hash, count(*)::BIGINT AS n FROM s WHERE n = 16 GROUP BY 1, 2",
        "triplet_index": f"WITH {_BYTES}, t AS (SELECT doc_id, v * 65536 + lead(v, 1) OVER w * 256 + lead(v, 2) OVER w AS key FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, key::BIGINT AS key, least(count(*), 1024)::BIGINT AS n FROM t WHERE key IS NOT NULL GROUP BY 1, 2",
        "piece_index": f"WITH {_pieces_sql()} SELECT doc_id, sha256, min(\"offset\") AS first_offset FROM pieces GROUP BY 1, 2",
        "ddelta_plan": f"WITH RECURSIVE {_LED},{_pieces_sql().removeprefix(_BYTES + ',')}, ch AS (SELECT ord, min(ord) OVER (PARTITION BY leader) AS parent FROM led), ix AS (SELECT doc_id AS parent, sha256, min(\"offset\") AS pat FROM pieces GROUP BY 1, 2) SELECT p.doc_id, p.chunk_no AS piece_no, CASE WHEN pat IS NULL THEN 'insert' ELSE 'copy' END AS op, pat AS parent_offset, p.length FROM ch JOIN pieces p ON p.doc_id = ch.ord LEFT JOIN ix ON ix.parent = ch.parent AND ix.sha256 = p.sha256 WHERE ch.ord <> ch.parent",
        "restore_documents": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "incremental_scrub": "SELECT min(doc_id) AS doc_id, true AS ok FROM documents GROUP BY text",
    }
    for name in ("spectral", "gear_samples", "gear_features"):
        sql[f"{name}_native"] = sql["spectral_sketch" if name == "spectral" else name]
    return sql | {f"roundtrip_{name}": _EVERY for name in CODECS}
