"""Near-duplicates by Jaccard similarity, and the pipeline's stage, against all pairs."""

import random
from collections import Counter

import corpus_pipeline as cp
import pyarrow as pa
import pytest

from lamina import ship
from lamina.llm import packing, similar, tokens

from . import brute
from .conftest import SCHEMA, cluttered, odd_rows, sentence


def groups(docs, k=5):
    """docs: (doc_id, text) -> smallest linked id of each, by exact Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in docs:
        w = brute.words((text or "").translate(brute.ASCII))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})
    todo, out = set(range(len(docs))), {}
    while todo:
        queue, group = [todo.pop()], []
        while queue:
            x = queue.pop()
            group.append(x)
            near = [y for y in todo if 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])]
            todo -= set(near)
            queue += near
        least = min((docs[i][0] for i in group if docs[i][0] is not None), default=None)
        out |= {i: least for i in group}
    return [out[i] for i in range(len(docs))]


def edited():
    """Texts, copies of them with some words replaced, and texts that share a passage only."""
    r = random.Random(5)
    texts, passage = [], sentence(r, 100)
    for _ in range(25):
        own = sentence(r, r.randint(60, 400)).split()
        for n in (0, 1, 2, 3, 5, 8, 12, 20):
            copy = list(own)
            for at in r.sample(range(len(own)), n):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [f"{sentence(r, 40)} {passage} {sentence(r, 40)}" for _ in range(30)]
    r.shuffle(texts)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("blocks", [(4096, 1 << 22, 8), (8, 900, 1)])
def test_similar_documents(spark, blocks):
    ship(spark)
    own = edited() + [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in odd_rows() if r[0] is None or r[0] < 2**60]
    df = cluttered(spark.createDataFrame(own, SCHEMA).repartition(5))
    got = similar.similar_documents(df, block=blocks[0], elements=blocks[1], seeds=blocks[2]).collect()
    want = groups([r[:2] for r in own])
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((r[0], g) for r, g in zip(own, want))


def test_stage_drops_edited_copies(spark):
    own = edited()
    kept = {r["doc_id"] for r in cp.near_dedup(spark, spark.createDataFrame(own, SCHEMA), "").collect()}
    assert kept == {r[0] for r, g in zip(own, groups([r[:2] for r in own])) if g == r[0]}


def test_empty(spark, empty):
    ship(spark)
    assert similar.similar_documents(empty).count() == 0


def test_a_worker_keeps_the_words_of_one_operator_and_few_sets():
    ids, texts = list(range(3000)), [f"w{i} x{i} y{i} z{i} common words" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * 3000, pa.int32()), pa.array(texts)], names=["doc_id", "bucket", "text"])
    pack = packing._pieces(4096, packing.default_tokenizer(), 2, False, 256)
    again = pa.RecordBatch.from_arrays([batch["doc_id"], batch["doc_id"], batch["text"]], names=["root", "node", "text"])
    before = pa.Table.from_batches(pack([batch]))
    words = tokens.TextIds.at(packing.default_tokenizer()).words
    assert len(words) > 3000 and words.parts
    sets = list(similar._sets(5)([again]))
    assert not words and not words.parts and len(similar._HASHES) > 3000
    assert len(sets) == 3 and pa.Table.from_batches(sets)["node"].to_pylist() == ids
    assert pa.Table.from_batches(pack([batch])) == before and not similar._HASHES
