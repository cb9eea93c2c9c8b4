"""The corpus pipeline: every stage's decisions against brute force on the stage's own input, for a
table, for odd rows with extra columns of clashing names, and for an empty table."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest

from . import brute
from .conftest import cluttered
from .test_operators import unhashed_last
from .test_similar import groups

STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def through(request, spark, sf_dir, odd, empty):
    """name -> (rows in, rows out, columns) of the stages in turn."""
    docs = {"table": lambda: spark.read.parquet(f"{sf_dir}/documents.parquet"), "odd": lambda: cluttered(odd), "empty": lambda: cluttered(empty)}[request.param]()
    seen, rows = {}, docs.collect()
    for name, f in cp.STAGES:
        made = cp.stage(f(spark, docs, sf_dir), f"test-{name.replace(' ', '-')}")
        seen[name] = rows, made.collect(), made.columns
        docs = made if request.param != "odd" or name == "packing" else cluttered(made)  # every stage gets odd columns
        rows = seen[name][1]
    return seen


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_columns_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixing", "packing"]


def test_columns(through):
    assert all(through[n][2] == cp.COLUMNS for n, _ in cp.STAGES[:-1])
    assert all(not out for rows, out, _ in through.values() if not rows)


def test_quality(through):
    given, kept, _ = through["quality rules"]
    good = pairs(r for r in given if not brute.quality(r["text"])[-1])
    assert pairs(kept) <= good and (sum(pairs(kept).values()) >= 0.6 * sum(good.values()))
    assert all(good[x] == n for x, n in pairs(kept).items())  # repeated rows share a verdict


def test_quality_trusts_every_good_document(spark, empty, tmp_path):
    labels, docs, trusted = unhashed_last(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scores, least = brute.ratio_scores([x[:2] for x in docs], trusted)
    want = {x[0] for x, s in zip(docs, scores) if not brute.quality(x[1])[-1] and s >= least}
    assert len(want) < len(docs)
    assert {r["doc_id"] for r in cp.quality(spark, spark.createDataFrame(docs, empty.schema), str(tmp_path)).collect()} == want


def test_line_dedup(through):
    given, kept, _ = through["line dedup"]
    made = brute.lines([(r["doc_id"], r["text"]) for r in given])
    want = Counter((r["doc_id"], text) for r, (n, gone, text) in zip(given, made) if n > gone)
    assert pairs(kept) == want and all(r["n_chars"] == len(r["text"]) for r in kept)


def test_near_duplicates(through):
    given, kept, _ = through["near-duplicates"]
    rows = sorted(pairs(given), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    of, left = groups(rows), pairs(kept)
    assert set(left.values()) <= {1} and set(left) <= set(rows)
    by = defaultdict(list)
    for row, least in zip(rows, of):
        by[least].append(row)
    for least, own in by.items():
        if least is not None:
            assert [d for d, _ in own if (d, _) in left] == [least]
    assert sum(left.values()) == len({x for x in of if x is not None}) + sum(1 for x in left if x[0] is None)


def test_repeated_null_ids_leave_one(spark, empty):
    rows = [(None, "one two three four five six", "en", "a", 1)] * 3 + [(None, "other words are here now too", None, None, None)] * 2
    kept = cp.near_dedup(spark, spark.createDataFrame(rows, empty.schema), "").collect()
    assert sorted(r["text"] for r in kept) == ["one two three four five six", "other words are here now too"]


def test_mixing(through):
    given, mixed, _ = through["mixing"]
    want, taken = Counter(), Counter()
    for d, n, _, _, t in brute.mixed([(r["doc_id"], len(brute.words(r["text"])), r["source"]) for r in given]):
        want[d, n] += t
    texts = defaultdict(list)
    for r in given:
        texts[r["doc_id"]].append(r["text"] or "")
    for r in mixed:
        whole = next(t for t in texts[r["doc_id"]] if t.startswith(r["text"]))
        taken[r["doc_id"], len(brute.words(whole))] += len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["text"]
    assert taken == +want


def test_packing(through):
    given, packed, _ = through["packing"]
    ids, got, by_seq = Counter(), Counter(), defaultdict(list)
    for r in given:
        ids[r["doc_id"]] += len(brute.ids(r["text"]))
    for r in packed:
        got[r["doc_id"]] += r["length"]
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == ids
    for x in by_seq.values():
        ends = [0]
        for at, n in sorted(x):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 4096
