"""Sketches, clusters, store and plans on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.gear import GEAR, rolling
from lamina.functions.parts import in_parts
from lamina.operators import chunking, cluster, graph, sketch, store
from lamina.plans.scrub import ScrubConfig, measure, scrub
from lamina.sources.tables import file_streams, memory_streams, write_report
from lamina.streaming import incremental

R = random.Random(3)


def test_pair_mix_and_pair_part():
    assert sketch.pair_mix(175, 113) == 0b11111111110
    six = sketch.ranked_counts({(175 + i, 113): i for i in range(6)})
    assert sketch.pair_part(six) == 0b1111111111 << 21
    assert sketch.pair_part(sketch.ranked_counts({(175 + i, 113): i for i in range(6)} | {(7, 7): 0})) == 0b1001001111 << 21
    assert sketch.pair_part([((1, 2), 5)]) == 0


def test_sketches_of_equal_and_empty_data():
    data = R.randbytes(5000)
    assert sketch.spectral_sketch(data) == sketch.spectral_sketch(bytes(data)) and sketch.spectral_sketch(b"") == 0
    assert sketch.gear_features(bytes(10_000), 12)[1] is None or sketch.gear_features(bytes(10_000), 12)[0] > 0
    assert sketch.super_features(None) is None


def test_rolling_gear_is_the_endless_one():
    data, h, want = R.randbytes(500), 0, []
    for b in data:
        h = (2 * h + int(GEAR[b])) % 2**64
        want.append(h % 2**32)
    assert rolling(np.frombuffer(data, dtype=np.uint8), 32).tolist() == want


def test_chunk_ends():
    assert len(chunking.gear_ends(b"")) == 0 and chunking.gear_ends(b"abc").tolist() == [3]
    big = R.randbytes(1_000_000)
    ends = chunking.gear_ends(big)
    assert len(ends) > 1 and ends[-1] == len(big) and (np.diff(ends) > 0).all()
    sizes = np.diff(np.r_[0, chunking.clamped_ends(big, 2048, 8192, 16384)])
    assert sizes.sum() == len(big) and (sizes[:-1] >= 2048).all() and sizes.max() <= 16384
    with pytest.raises(ValueError):
        chunking.clamped_ends(b"x", 5, 4, 6)


def test_leader_pass_and_islands(spark):
    keys = [R.randrange(0, 4000) for _ in range(400)] + [2**32 - 1, 2**32 - 5, 0]
    rows = [(str(i), i, k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "chunk_id string, ord long, sketch long").repartition(5)
    got = {r["ord"]: r["cluster_key"] for r in cluster.leader_clusters(df).collect()}
    led, want = [], {}
    for _, o, s in rows:
        near = sorted((abs(x - s), x) for x in led if abs(x - s) <= 10)
        if not near:
            led.append(s)
        want[o] = near[0][1] if near else s
    assert got == want
    isle = {r["sketch"]: r["island"] for r in cluster.islands(df, parts=1 << 24).collect()}  # ranges of 256
    last, head, expect = None, None, {}
    for s in sorted(set(keys)):
        head = s if last is None or s - last > 10 else head
        expect[s], last = head, s
    assert isle == expect


def test_known_leaders_come_first(spark):
    df = spark.createDataFrame([("a", 0, 105), ("b", 1, 130)], "chunk_id string, ord long, sketch long")
    got = {r["chunk_id"]: r["cluster_key"] for r in cluster.leader_clusters(df, known=spark.createDataFrame([(100,)], "leader long")).collect()}
    assert got == {"a": 100, "b": 130}


def _tokens(spark, edges):
    return spark.createDataFrame([(v, f"{a}-{b}") for a, b in edges for v in (a, b)], "node long, token string")


@pytest.mark.parametrize("bound", [25, 50_000])
def test_greedy_leaders(spark, bound):
    n = 80
    edges = {(a, b) for a in range(n) for b in range(a) if R.random() < 0.03}
    want = {}
    for v in range(n):
        near = sorted(u for u in want if want[u] == u and ((v, u) in edges or (u, v) in edges))
        want[v] = near[0] if near else v
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "node long, ord long")
    got = graph.greedy_leaders(nodes, _tokens(spark, sorted(edges)), bound)
    assert {r["node"]: r["leader"] for r in got.collect()} == want


def test_greedy_leaders_of_a_long_path(spark):
    n = 1000
    nodes = spark.createDataFrame([(i, (0, i)) for i in range(n)], "node long, ord struct<stream_id:long,chunk_no:long>")
    path = _tokens(spark, [(i, i + 1) for i in range(n - 1)])
    for bound in (50_000, 600):
        got = {r["node"]: r["leader"] for r in graph.greedy_leaders(nodes, path, bound).collect()}
        assert got == {i: i - i % 2 for i in range(n)}


@pytest.mark.parametrize("mismatches", [2, 6])
def test_partial_clusters(spark, mismatches):
    r = random.Random(9)
    keys = [[str(r.randrange(4)) for _ in range(6)] for _ in range(60)] + [None, None]
    df = spark.createDataFrame([(str(i), i, k) for i, k in enumerate(keys)], "chunk_id string, ord long, super_features array<string>").repartition(4)
    led, want = [], {}
    for i, k in enumerate(keys):
        near = [j for j in led if (k is None) == (keys[j] is None) and (k == keys[j] or k is not None and sum(a != b for a, b in zip(k, keys[j])) < mismatches)]
        want[i] = near[0] if near else i
        led += [] if near else [i]
    for bound in (25, 50_000):
        got = cluster.partial_clusters(df, mismatches=mismatches, bound=bound).collect()
        first = {}
        for x in sorted(got, key=lambda x: x["ord"]):
            first.setdefault(x["cluster_key"], x["ord"])
        assert {x["ord"]: first[x["cluster_key"]] for x in got} == want


@pytest.mark.parametrize("width, bound", [(0, 50_000), (10, 50_000), (10, 60), (700, 60)])
def test_leader_clusters_in_rounds(spark, width, bound):
    r = random.Random(width + bound)
    keys = [r.randrange(0, 3000) for _ in range(250)] + [2**32 - 1, 2**32 - 5, 0] + [10 * i for i in range(40)]
    df = spark.createDataFrame([(str(i), (i // 7, i % 7), k) for i, k in enumerate(keys)], "chunk_id string, ord struct<stream_id:long,chunk_no:long>, sketch long").repartition(3)
    led, want = [], {}
    for i, s in enumerate(keys):
        near = sorted((abs(x - s), x) for x in led if abs(x - s) <= width)
        want[str(i)] = near[0][1] if near else s
        led += [] if near else [s]
    assert {x["chunk_id"]: x["cluster_key"] for x in cluster.leader_clusters(df, width, bound=bound).collect()} == want


def test_scrub_over_files_with_leader_clusters(spark, tmp_path):
    """Hashed stream ids of 64 bits, ordered by (stream, chunk)."""
    base = R.randbytes(30_000)
    for i in range(4):
        (tmp_path / f"f{i}").write_bytes(base[: 10_000 * (1 + i % 3)] + R.randbytes(3000) + bytes(500))
    streams = file_streams(spark, str(tmp_path)).select("stream_id", "data")
    from lamina import ship

    ship(spark)
    for config in (ScrubConfig("spectral", "leader", "edit"), ScrubConfig("spectral", "leader", "gdelta", width=1 << 24), ScrubConfig("gear", "leader", "xdelta")):
        chunks = chunking.clamped_chunks(streams, 512, 2048, 4096).withColumn("chunk_id", F.col("sha256"))
        made = scrub(store.unique_chunks(chunks), config)
        back = {r["stream_id"]: bytes(r["data"]) for r in store.restore(store.manifest(chunks, made.store), made.store).collect()}
        assert back == {r["stream_id"]: bytes(r["data"]) for r in streams.collect()}


def test_leader_distances(spark):
    df = spark.createDataFrame([(k,) for k in (5, 5, 90, 2**32 - 1, 300)], "cluster_key long")
    got = {r["leader"]: (r["below"], r["above"]) for r in cluster.leader_distances(df).collect()}
    assert got == {5: (None, 85), 90: (85, 210), 300: (210, 2**32 - 301), 2**32 - 1: (2**32 - 301, None)}
    keys = (5, 90, 300, 2**32 - 1)
    for block in (1, 2, 2048):
        assert {tuple(r) for r in cluster.all_leader_distances(df, block).collect()} == {(a, b, abs(a - b)) for a in keys for b in keys if a != b}


def _units(spark):
    base = [R.randbytes(3000) for _ in range(4)]
    data = []
    for b in base:
        for k in range(4):
            x = bytearray(b)
            x[100 * k : 100 * k + 3] = b"abc"
            data.append(bytes(x))
    data += [b"", b"x", bytes(5000)]
    return spark.createDataFrame([(str(i), i, bytearray(d)) for i, d in enumerate(data)], "chunk_id string, ord long, data binary"), data


@pytest.mark.parametrize("config", [ScrubConfig(), ScrubConfig(sketch="spectral", clusterer="leader", width=1 << 30), ScrubConfig(clusterer="equal", codec="zdelta"), ScrubConfig(sketch="spectral", clusterer="equal", codec="edit"), ScrubConfig(clusterer="leader", codec="xdelta_zstd", shrink_only=True)])
def test_scrub_is_lossless(spark, config):
    units, data = _units(spark)
    made = scrub(units.repartition(3), config)
    got = {r["chunk_id"]: bytes(r["data"]) for r in store.decode(made.store, made.store).collect()}
    assert got == {str(i): d for i, d in enumerate(data)}
    keys = [tuple(r) for r in made.store.select(*store.KEY).collect()]
    assert len(keys) == len(set(keys)) == len(data)


def test_scrub_does_not_depend_on_partitions(spark):
    units, _ = _units(spark)
    a, b = (sorted(map(tuple, scrub(units.repartition(n)).store.select(*store.KEY, "chunk_id").collect())) for n in (1, 7))
    assert a == b


def test_store_insert_get_contains_clear(spark, tmp_path):
    units, data = _units(spark)
    rows = scrub(units).store
    path = str(tmp_path / "store")
    store.write(rows, path)
    kept = store.read(spark, path)
    assert kept.count() == len(data)
    keys = kept.select(*store.KEY).limit(5).unionByName(spark.createDataFrame([("none", "simple", 0)], "cluster_key string, chunk_type string, number int"))
    got = {tuple(r)[:3]: r["data"] for r in store.get(kept, keys).collect()}
    assert len(got) == 6 and got[("none", "simple", 0)] is None and sum(v is not None for v in got.values()) == 5
    assert store.contains(kept, keys).count() == 5
    orphan = kept.filter("chunk_type = 'delta'").limit(1)
    with pytest.raises(Exception, match="no leader"):
        store.decode(orphan, kept.filter("role = 'nobody'")).collect()
    again = spark.createDataFrame(kept.limit(1).withColumn("payload", F.lit(b"new")).collect(), kept.schema)
    key = tuple(again.select(*store.KEY).first())
    store.insert(again, path)  # a key that is there: the new row takes its place
    kept = store.read(spark, path)
    assert kept.count() == len(data) and [bytes(r["payload"]) for r in kept.collect() if tuple(r[k] for k in store.KEY) == key] == [b"new"]
    store.insert(spark.createDataFrame([("other", "simple", 0, "leader", None, "o", bytearray(b"x"))], store.SCHEMA), path)
    assert store.read(spark, path).count() == len(data) + 1
    store.clear(spark, path)
    assert store.read(spark, path).count() == 0
    store.insert(again, str(tmp_path / "fresh"))
    assert store.read(spark, str(tmp_path / "fresh")).count() == 1


def test_second_scrub_adds_only_new_chunks(spark):
    units, data = _units(spark)
    first = scrub(units.filter("ord < 9")).store
    second = scrub(units, existing=first).store
    assert first.count() + second.count() == len(data)
    both = first.unionByName(second)
    assert both.select(*store.KEY).distinct().count() == len(data)
    assert {r["chunk_id"]: bytes(r["data"]) for r in store.decode(both, both).collect()} == {str(i): d for i, d in enumerate(data)}


def _probe(wanted, taken, top):
    used, out = set(taken), []
    for h in wanted:
        at = next(c for d in range(top + 2) for c in (h + d, h - d) if 0 <= c <= top and c not in used)
        used.add(at)
        out.append(at)
    return out


@pytest.mark.parametrize("wanted, taken, top", [([5, 5, 5, 5, 0, 0], [], 9), ([2**32 - 1], [2**32 - 1], 2**32 - 1), ([3] * 9, [3, 5], 20), ([R.randrange(60) for _ in range(25)], [R.randrange(60) for _ in range(9)], 59)])
def test_probe_cells(spark, wanted, taken, top):
    asked = spark.createDataFrame(list(enumerate(wanted)), "ord long, cell long").repartition(3)
    got = store.probe_cells(asked, spark.createDataFrame([(c,) for c in taken], "cell long"), top)
    assert [r["at"] for r in sorted(got.collect(), key=lambda r: r["ord"])] == _probe(wanted, taken, top)


def test_probe_of_a_full_table(spark):
    with pytest.raises(ValueError):
        store.probe_cells(spark.createDataFrame([(i, 0) for i in range(3)], "ord long, cell long"), spark.createDataFrame([], "cell long"), 1)


@pytest.mark.parametrize("top, reach, rows, bound", [(40, 12, 90, 50_000), (40, 12, 90, 40), (60, 200, 50, 20), (2000, 3, 30, 20), (2000, 12, 20, 20), (49, None, 40, 25)])
def test_probe_of_more_cells_than_there_are(spark, top, reach, rows, bound):
    """As in the query's SQL, whose search ends after so many candidates: null then."""
    r = random.Random(top + rows)
    wanted = [r.choice([0, 3, top, r.randrange(top + 1), r.randrange(top + 1)]) for _ in range(rows)]
    taken = [r.randrange(top + 1) for _ in range(9)]
    used, want = set(taken), []
    for h in wanted:
        tries = (h + ((k + 1) // 2 if k % 2 else -(k // 2)) for k in range(reach or 2 * top + 2))
        at = next((c for c in tries if 0 <= c <= top and c not in used), None)
        used.add(at)
        want.append(at)
    asked = spark.createDataFrame(list(enumerate(wanted)), "ord long, cell long").repartition(3)
    got = store.probe_cells(asked, spark.createDataFrame([(c,) for c in taken], "cell long"), top, reach, bound)
    assert [r["at"] for r in sorted(got.collect(), key=lambda r: r["ord"])] == want


def test_every_distance_of_leaders_in_blocks(spark):
    keys = random.Random(4).sample(range(2**32), 70)
    df = spark.createDataFrame([(k,) for k in keys * 2], "cluster_key long")
    got = cluster.all_leader_distances(df, block=8)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, abs(a - b)) for a in keys for b in keys if a != b)
    assert got.rdd.getNumPartitions() > 20  # the pairs of blocks are spread, however few bytes they are


def test_built_in_forms_move_no_row_a_byte(spark):
    """Spans meet without a seam, and only hits and counts are shuffled."""
    r = random.Random(8)
    texts = [None, b"", b"a", b"ab", bytes(9000), *(r.randbytes(n) for n in (31, 4095, 4096, 4097, 20_000))]
    df = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "doc_id long, data binary")
    made = [sketch.gear_features(t or b"", 12) for t in texts]
    data = F.col("data")
    got = sketch.gear_samples_native(df, "doc_id", data)
    assert dict(map(tuple, got.collect())) == {i: n for i, (n, _) in enumerate(made)}
    found = {(x["doc_id"], x["pos"]): x["value"] for x in sketch.gear_features_native(df, "doc_id", data).collect()}
    assert found == {(i, k): v for i, (_, f) in enumerate(made) for k, v in enumerate(f or [])}
    for bits in (6, 13):
        cuts = chunking.gear_cuts(df, "doc_id", data, bits)
        assert sorted(map(tuple, cuts.collect())) == [(i, e) for i, t in enumerate(texts) for e in chunking.gear_ends(t or b"", bits).tolist()[:-1]]
    assert "Window" not in cuts._jdf.queryExecution().toString() and "Exchange" not in cuts._jdf.queryExecution().toString()
    assert dict(map(tuple, sketch.spectral_native(df, "doc_id", data).collect())) == {i: sketch.spectral_sketch(t or b"") for i, t in enumerate(texts)}


def test_workers_take_batches_in_parts():
    """Objects of a whole batch of texts were held at once."""
    import pyarrow as pa

    data = [None, b"", *(R.randbytes(900_000) for _ in range(9)), R.randbytes(6_000_000), *[b"abc" * 5] * 2500]
    batch = pa.RecordBatch.from_pydict({"stream_id": range(len(data)), "chunk_id": range(len(data)), "data": pa.array(data, pa.binary())})
    for f in (chunking._chunker(chunking.gear_ends), sketch._sketcher("gear", ("chunk_id",), 7, 2, 6)):
        made = list(f([batch]))
        assert len(made) >= 6 and max(x.nbytes for x in made) < 9_000_000
    parts = list(in_parts([batch], "data"))
    assert sum((x["data"].to_pylist() for x in parts), []) == data and [len(x) for x in in_parts([batch.slice(0, 0)], "data")] == [0]


def test_only_named_leaders_move(spark):
    led = spark.createDataFrame([(str(i), bytearray(b"x")) for i in range(50)], "cluster_key string, parent binary")
    rows = spark.createDataFrame([("3",), ("3",), ("7",)], "cluster_key string")
    assert sorted(r["cluster_key"] for r in store._named(led, rows).collect()) == ["3", "7"]
    assert store._named(led, rows, 1).count() == 50


def test_empty_input(spark):
    none = spark.createDataFrame([], "chunk_id string, ord long, data binary")
    assert scrub(none).store.count() == 0
    assert chunking.gear_chunks(spark.createDataFrame([(1, None), (2, bytearray())], "stream_id long, data binary")).count() == 0


def test_measure_and_report(spark, tmp_path):
    streams = memory_streams(spark, bytes(200_000), R.randbytes(50_000))
    row = measure(streams, lambda s: chunking.clamped_chunks(s, 2048, 4096, 8192))
    assert row.first()["cdc_dedup_ratio"] > 2
    write_report(row, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 1


def test_files_and_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}").write_bytes(R.randbytes(2000))
    assert file_streams(spark, str(folder)).count() == 5
    table = str(tmp_path / "table")
    streams = spark.createDataFrame([(i, bytearray(R.randbytes(1500))) for i in range(6)] * 2, "stream_id long, data binary")
    streams.write.parquet(table)
    for _ in range(2):  # the second start finds nothing new
        q = incremental.start(spark.readStream.schema(streams.schema).parquet(table), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        q.awaitTermination()
    kept = store.read(spark, str(tmp_path / "out"))
    assert kept.count() == 6 and kept.select("chunk_id").distinct().count() == 6
    streams.withColumn("stream_id", F.col("stream_id") + 100).write.mode("append").parquet(table)
    incremental.start(spark.readStream.schema(streams.schema).parquet(table), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert store.read(spark, str(tmp_path / "out")).count() == 6


@pytest.mark.parametrize("bad", [dict(sketch="x"), dict(clusterer="x"), dict(codec="x"), dict(sketch="spectral", clusterer="partial")])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        ScrubConfig(**bad)


def test_sketch_config_is_checked(spark):
    units, _ = _units(spark)
    for bad in (dict(kind="x"), dict(groups=0), dict(supers=0)):
        with pytest.raises(ValueError):
            sketch.sketches(units, **bad)
