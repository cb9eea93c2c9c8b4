"""The ten corpus operators: against brute force over the smallest tables and over odd rows; empty
tables; extra columns."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import ship
from lamina.llm import lines, mixing, neardup, packing, pii, quality, queries, sharding, substrings, topk, urls

from . import brute
from .conftest import cluttered, odd_rows

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module", params=["table", "odd"])
def given(request, docs, odd):
    """(DataFrame, its rows as (doc_id, text, source))."""
    df = docs if request.param == "table" else cluttered(odd)
    return df, [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def rows(df):
    return df.collect()


# -- 1 packing ------------------------------------------------------------------------------------


def test_packing(given):
    df, own = given
    got = rows(packing.pack(df, with_ids=True))
    want = Counter((d, brute.crc(t), len(t)) for d, x, _ in own for t in [brute.ids(x)])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    texts = defaultdict(list)
    for d, x, _ in own:
        texts[d, len(brute.ids(x))].append(brute.ids(x))
    assert set(by_doc) == {(d, n) for d, _, n in want}
    for k, all_ids in texts.items():  # every piece of every copy
        made = Counter((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[k])
        spans = sorted({(r["start"], r["length"]) for r in by_doc[k]})
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) == k[1]
        assert made == Counter((a, n, brute.crc(i[a : a + n])) for i in all_ids for a, n in spans)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(by_seq) * 4096 <= 1.02 * total + 3 * 4096


@pytest.mark.parametrize("capacity", [2, 3, 64, 4096])
def test_cut_covers_and_classes_fit(capacity):
    for n in [*range(1, 400), 4095, 4096, 4097, 100_000]:
        at = 0
        for start, length, k in packing.pieces_of(n, capacity):
            assert start == at and k * length <= capacity
            at += length
        assert at == n


# -- 2 mixing -------------------------------------------------------------------------------------


def test_mixing(given):
    df, own = given
    got = rows(mixing.mixed_documents(df))
    again = rows(mixing.mixed_documents(df.repartition(3)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(brute.words(t))) for d, t, _ in own)
    want = brute.mixed([(d, len(brute.words(t)), s) for d, t, s in own])
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == Counter((d, n, size, taken) for d, n, size, _, taken in want)
    aims = {(d, n, size): target for d, n, size, target, _ in want}
    taken, of = Counter(), Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[r["target"]] += r["taken"]
    for _, _, s in {(d, t, s) for d, t, s in own}:
        of[s] += 1
    sizes = Counter()
    for _, t, s in own:
        sizes[s] += len(brute.words(t))
    for t, n in taken.items():
        peers = sum(abs(t - x) < 1e-6 * (1 + x) for x in brute.targets(sizes).values())
        assert abs(n - peers * t) <= 2 * peers
    assert all(abs(r["target"] - aims[r["doc_id"], r["size"], r["source_size"]]) < 1e-6 * (1 + r["target"]) for r in got if sum(k[:2] == (r["doc_id"], r["size"]) for k in aims) == 1)


def test_mix_is_cut_at_the_budget(given):
    df, own = given
    packets = rows(mixing.mix(df))
    total = sum(len(brute.words(t)) for _, t, _ in own)
    assert sum(r["words"] for r in packets) == int(1.5 * total)
    assert all(0 <= r["words"] <= r["size"] for r in packets)
    whole = sorted((r["mix_end"], r["words"], r["finish"]) for r in packets if r["words"])
    assert [f for *_, f in whole] == sorted(f for *_, f in whole) and all(a[0] <= b[0] for a, b in zip(whole, whole[1:]))
    assert whole[-1][0] == int(1.5 * total) if whole else not total


# -- 3 quality ------------------------------------------------------------------------------------


def test_quality(given, spark, sf_dir):
    df, own = given
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = rows(quality.quality_rules(df, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((d, *brute.quality(t)) for d, t, _ in own)
    assert not any(r["kept"] and r["base_failed"] for r in got) and all(r["kept"] is not None for r in got)
    assert (len({(r["doc_id"], r["n_words"], r["kept"]) for r in got})) == len({(r["doc_id"], r["n_words"]) for r in got})


def test_quality_scores_and_verdicts(given, spark, sf_dir):
    """Scores, threshold and verdicts against a direct count."""
    df, own = given
    ids = sorted({d for d, *_ in own if d is not None})
    labels = spark.createDataFrame([(d, int(i % 3 > 0), int(i % 7 == 1)) for i, d in enumerate(ids)], LABELS)
    trusted = {d for i, d in enumerate(ids) if i % 3 > 0 and i % 7 != 1}
    scores, least = brute.ratio_scores([(d, t) for d, t, _ in own], trusted)
    want = defaultdict(list)
    for (d, t, _), s in zip(own, scores):
        want[d, brute.quality(t)[0]].append((s, brute.quality(t)[-1]))
    for r in rows(quality.quality_rules(df, labels)):
        near = [(s, bad) for s, bad in want[r["doc_id"], r["n_words"]] if (s is None) == (r["score"] is None) and (s is None or abs(s - r["score"]) < 2e-6)]
        assert near
        s, bad = near[0]
        if s is not None and abs(s - least) > 2e-6:
            assert r["kept"] == (not bad and s >= least)


def unhashed_last(spark, n=24_000, few=60):
    """Labels of n good ids, and documents of the `few` ids whose hashes come last: (labels, documents, trusted ids)."""
    import random

    r = random.Random(5)
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.when(F.col("id") % 2 == 0, 0).alias("toxic"))
    last = [x["doc_id"] for x in labels.orderBy(F.xxhash64("doc_id").desc()).limit(few).collect()]
    word = lambda k: "".join(r.choice("qxzjkvw0123456789") for _ in range(k))
    good = [word(5) for _ in range(40)]
    docs = [(d, " ".join(r.choice(good) for _ in range(120)), "en", "s", 1) for d in last]
    docs += [(10**9 + i, " ".join(word(7) for _ in range(120)), "en", "s", 1) for i in range(20)]
    return labels, docs, set(last)


def test_quality_trusts_every_good_document(spark, empty):
    labels, docs, trusted = unhashed_last(spark)
    scores, least = brute.ratio_scores([x[:2] for x in docs], trusted)
    assert any(s < least for s in scores)
    got = {r["doc_id"]: r for r in rows(quality.quality_rules(spark.createDataFrame(docs, empty.schema), labels))}
    for (d, t, *_), s in zip(docs, scores):
        assert abs(got[d]["score"] - s) < 2e-6 and got[d]["kept"] == (not brute.quality(t)[-1] and s >= least)


@pytest.mark.parametrize("bits", [(64, 64), quality.MAYBE_BITS])
def test_trusted_rows_are_exact(spark, odd, bits):
    """Also with a bitmap that lets most through; null ids are never trusted, repeated rows all."""
    trusted = spark.createDataFrame([(d,) for d in (1, 2, 9, 2**62, -5, 105, *range(10**6, 10**6 + 99))], "doc_id long")
    count = lambda rows_: Counter((r["doc_id"], r["text"]) for r in rows_)
    own = rows(odd)
    for of in (trusted, trusted.limit(0)):
        held = {r["doc_id"] for r in of.collect()}
        met, rest = quality.dealt(odd, of, bits)
        assert count(rows(met.filter("trusted"))) == count(r for r in own if r["doc_id"] in held)
        assert count(rows(met) + rows(rest)) == count(own)


def test_buckets_grow(spark):
    sized = lambda n: quality.buckets_for(spark.range(n).select(F.repeat(F.lit("x"), 1 << 20).alias("text")))
    assert sized(0) == sized(1) == quality.BUCKETS[0] and sized(300) == 8192 and sized(600) == 16384


def test_quality_hashes_each_word_once(spark, odd):
    """Grams are counted in compiled code, without lambdas, by the buckets that scores look up; scoring hashes a text's words once."""
    import re

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    orders, buckets = (1, 2, 3), 64
    counted = quality._grams(odd.select("text", F.lit(1).alias("half")), orders, buckets)
    assert "lambda" not in plan(counted)
    want = Counter()
    for r in rows(quality._hashes(odd.withColumn("__w", quality.words(F.col("text"))), max(orders))):
        want.update(h % buckets + k * buckets for k, n in enumerate(orders) for h in r[f"__{n}"])
    assert Counter(r["b"] for r in rows(counted)) == want
    weights = spark.range(1).select(F.array_repeat(F.lit(1.0), 2 * buckets).alias("w0"), F.array_repeat(F.lit(1.0), 2 * buckets).alias("w1"))
    assert len(re.findall(r"xxhash64\(lambda \w+#\d+L?, 42\)", plan(quality._scored(odd, weights, (1, 2), buckets)))) == 1


def test_quality_keeps_clean_and_drops_noise(spark):
    import random

    r = random.Random(1)
    common = "the of and to in that was for on with as his be at by had this have from they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many before must well back through years where much your way down should because long each just state those people too mr how little good world very great still".split()
    clean = [(i, " ".join(r.choice(common) for _ in range(150)), "en", "s", 1) for i in range(300)]
    noise = [(1000 + i, " ".join("".join(r.choice("qxzjkvw0123456789#$%") for _ in range(7)) for _ in range(150)), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(clean + noise, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(5)], LABELS)
    got = {x["doc_id"]: x["kept"] for x in rows(quality.quality_rules(df, labels))}
    assert sum(got[i] for i in range(300)) >= 295 and not any(got[1000 + i] for i in range(30))
    none = quality.quality_rules(df, labels.limit(0))
    assert none.filter("kept").count() == sum(not brute.quality(x[1])[-1] for x in clean + noise)


# -- 4 URLs ---------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://Example.COM/en/7817?x#y": ("example.com", "/en/7817", "example.com/en/7", "allow"), "https://a.b.example.com/en/6": ("a.b.example.com", "/en/6", "com/en/", "block"),
        "https://badexample.com/en/7": ("badexample.com", "/en/7", "com/en/", "block"), "//no/scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "x://h": ("h", "", None, "allow"), "x://h?p://q/r": ("h", "", None, "allow"), "x://com/en": ("com", "/en", None, "allow"), "x://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://sub.example.net/de/81": ("sub.example.net", "/de/81", "example.net/de/8", "block"), "http://other.net/de/81": ("other.net", "/de/81", "net/de/", "allow"), "http://x.org/es/": ("x.org", "/es/", "org/es/", "block"),
        "http://É.Org/ES/": ("É.org", "/ES/", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = cluttered(spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(None, None), (3, "//no/scheme")], "page_id long, url string"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = rows(urls.url_filter(pages, none))
    assert len(got) == len(cases) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]], r["url"]


def test_unlabelled_hosts_are_judged_by_their_domain(spark, tmp_path):
    """The operator and the SQL on tables where the method blocks."""
    import duckdb

    pages = [(i, f"http://h{i % 10}.bad.xx/p{i}") for i in range(60)] + [(100 + i, f"http://h{i % 10}.good.xx/p{i}") for i in range(60)]
    pages += [(200, "http://new.bad.xx/"), (201, "http://new.good.xx/"), (202, "http://other.yy/"), (203, "http://a.b.co.uk:80/x"), (204, "http://10.0.0.1/"), (205, "http://u@h1.bad.xx/"), (206, "http://example.com/en/7"), (207, None)]
    labels = [(i, 0 if i < 100 else 1, 0) for i in range(160)] + [(203, 1, 1), (206, None, 1)]
    df, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    lab.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op4_urls(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == set(con.sql(urls.URL_SQL).fetchall())
    of = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert of[200] == of[0] == of[205] == "block" and of[201] == of[202] == of[100] == "allow"


def test_host_reputation_shrinks(spark):
    hosts = [(f"h{i}.bad.xx", 1) for i in range(8) for _ in range(6)] + [(f"h{i}.good.xx", 0) for i in range(8) for _ in range(6)] + [("new.bad.xx", 1), ("new.good.xx", 1), ("a.yy", None)]
    got = {r["host"]: r for r in rows(urls.host_reputation(spark.createDataFrame(hosts, "host string, bad int")))}
    assert got["new.bad.xx"]["mean"] > got["new.good.xx"]["mean"] and "a.yy" not in got
    assert got["h0.bad.xx"]["low"] > 0.5 > got["h0.good.xx"]["mean"] and all(0 <= r["low"] <= r["mean"] <= 1 or r["low"] < 0 for r in got.values())
    one = rows(urls.host_reputation(spark.createDataFrame([("h", 1)], "host string, bad int")))
    assert len(one) == 1 and 0 < one[0]["mean"] < 1


# -- 5 near-duplicates ----------------------------------------------------------------------------


def test_neardup(given):
    df, own = given
    prints = [(d, brute.fingerprint(t)) for d, t, _ in own]
    of = brute.components(prints)
    want = Counter((d, fp, of[fp]) for d, fp in prints)
    for how in ({"block": 8}, {}) if len(own) < 150 else ({},):
        got = rows(neardup.near_duplicates(df, **how))
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want, how


@pytest.mark.parametrize("block", [16, 4096])
def test_links_lose_none(spark, block):
    ship(spark)
    r = np.random.default_rng(4)
    seeds = [int(x) for x in r.integers(0, 2**63, 20)]
    fps = {s ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for s in seeds for _ in range(40)} | {0, 2**64 - 1, 2**63}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    edges = neardup.links(spark.createDataFrame(signed, "fp long"), block)
    got = {x["node"]: x["root"] for x in rows(neardup.components(edges))}
    want = brute.components([(x - 2**64 if x >= 2**63 else x, x) for x in fps])
    for x in fps:
        s = x - 2**64 if x >= 2**63 else x
        assert got.get(s, s) == want[x]


def test_chain_budgets_prune():
    r = np.random.default_rng(8)
    fps = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    pairs = [(x, x ^ np.uint64(sum(1 << int(b) for b in r.choice(64, 4, replace=False)))) for x in fps[:300]]
    for x, y in pairs:  # every link passes some start's budgets, and few others pass any
        assert any(len(neardup.near(x, np.array([y]), neardup._chain(s))) and not (x ^ y) >> np.uint64(neardup.SEGMENTS[s][0]) & np.uint64((1 << neardup.SEGMENTS[s][1]) - 1) for s in range(5))
    first = neardup._chain(0)[0]
    left = np.bitwise_count((fps[1:] ^ fps[0]) & first) <= 1
    assert left.sum() < 0.01 * len(fps)


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in rows(neardup.components(path))} == {0}


# -- 6 PII ----------------------------------------------------------------------------------------


def test_pii(given):
    df, own = given
    got = rows(pii.replace_pii(df))
    assert len(got) == len(own) and Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in own)
    whole = {(r["doc_id"], r["n_entities"], r["text"]) for r in got}
    of_value: dict = {}
    for d, t, _ in own:
        found = brute.entities(t or "")
        made = [r for r in whole if r[0] == d and (r[2] is None) == (t is None) and r[1] == len(found)]
        assert made
        if not found:
            assert (d, 0, t) in whole
        elif len(made) == 1:  # the same text around them, entity by entity another of the same form
            parts, new, at = brute.around(t, found), made[0][2], 0
            for (kind, value), (before, after) in zip([x[2:] for x in found], parts):
                assert new.startswith(before, at)
                at += len(before)
                end = new.index(after[:12], at) if after else len(new)
                made_of, at = new[at:end], end
                assert brute.form(kind, made_of) == brute.form(kind, value) and made_of != value
                assert of_value.setdefault((kind, brute.name_of(kind, value)), brute.name_of(kind, made_of)) == brute.name_of(kind, made_of)
    assert len(set(of_value.values())) == len(of_value) and not {v for _, v in of_value} & set(of_value.values())


def test_pii_against_planted_values(spark):
    """Entities of every kind put into clean words: found, all and only they."""
    import random

    ship(spark)
    r = random.Random(6)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))

    def card(n):
        front = "4" + digits(n - 2)
        return front + str(-sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(front))) % 10)

    made = {
        "email": lambda: f"{word()}.{digits(2)}@{word()}.{word()}.example.com", "card": lambda: r.choice([digits(16), card(15), card(19)]), "ip": lambda: ".".join(str(r.randint(1, 250)) for _ in range(4)),
        "phone": lambda: r.choice([f"+1 ({r.randint(200, 999)}) 555-{digits(4)}", f"{r.randint(200, 999)}-555-{digits(4)}", f"+49 30 {digits(7)}"]), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "secret": lambda: r.choice(["".join(r.choice("0123456789abcdef") for _ in range(38)) + "7f", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))]),
        "ip6": lambda: ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8)), "name": lambda: f"{r.choice(['Mr', 'Frau', 'Dr.'])} {word().capitalize()}son",
    }
    docs, planted = [], []
    for i in range(60):
        words, own = [word() for _ in range(60)], []
        for _ in range(i % 4):
            kind = r.choice(sorted(made))
            own.append((kind, made[kind]()))
            words.insert(r.randint(0, len(words)), own[-1][1])
        docs.append((i, " ".join(words)))
        planted.append(own)
    got = {x["doc_id"]: (x["n_entities"], x["text"]) for x in rows(pii.replace_pii(spark.createDataFrame(docs, "doc_id long, text string")))}
    for (i, text), own in zip(docs, planted):
        n, new = got[i]
        assert n == len(own) and (own or new == text), (text, new)
        for kind, value in own:
            secret = value.split(" ")[-1] if kind == "name" else value
            assert secret not in new
        assert len(new.split()) == len(text.split()) and sum(a != b for a, b in zip(text.split(), new.split())) >= len(own)


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "@", "A" * 1_000_000 + "@", "@" * 1_000_000, "a." * 500_000 + "@" + "b." * 500_000, "0123456789abcdef" * 60_000 + "z", "1:" * 500_000])
def test_pii_of_very_long_words_is_linear(text):
    import time

    t = time.process_time()
    pii.replaced(text, pii.KEY, {})
    assert time.process_time() - t < 15  # a quadratic search takes hours


@pytest.mark.parametrize("text", ["Dr Öß", "Herr Ёй", "Anna Ñóé", "Dr Müller", "Mr Ng", "Frau Ääää", "Señora Ώμε"])
def test_pii_of_any_letters(spark, text):
    ship(spark)
    new = rows(pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]["text"]
    assert all(a != b for a, b in zip(text.split(" ")[1:], new.split(" ")[1:])) and len(new.split(" ")[-1]) == len(text.split(" ")[-1])


def test_pii_surnames_agree_and_crowded_names_get_longer(spark):
    ship(spark)
    both = [(1, "Anna Keller met Dr. Keller; Keller said."), (2, "Frau Keller")]
    got = {r["doc_id"]: r["text"] for r in rows(pii.replace_pii(spark.createDataFrame(both, "doc_id long, text string")))}
    name = got[2].split()[1]
    assert got[1].count(name) == 3 and "Keller" not in got[1]
    every = [f"{a}{b}" for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"]  # all names of the form
    crowd = spark.createDataFrame([(i, f"Mr {x}") for i, x in enumerate(every)], "doc_id long, text string")
    for bound in (pii.MOVED, -1):
        made = [r["text"].split()[1] for r in rows(pii.replace_pii(crowd, moved_bound=bound))]
        assert len(set(made)) == len(every) and not set(made) & set(every)


def test_pii_types_and_coreference(spark):
    ship(spark)
    text = "Mail Anna Keller (anna.k@mail.example.com), Mr. John Smith or Dr Иванов; call +1 (212) 555-0199 or 212-555-0199, card 4111 1111 1111 1111, at 10.0.0.7 and 8.8.8.8, key 0123456789abcdef0123456789abcdef, 078-05-1120. Anna Keller wrote."
    df = spark.createDataFrame([(1, text), (2, text.replace("Mail", "To")), (3, None), (4, "")], "doc_id long, text string")
    for bound in (pii.MOVED, -1):
        got = {r["doc_id"]: r["text"] for r in rows(pii.replace_pii(df, moved_bound=bound))}
        assert got[1].replace("Mail", "To") == got[2] and got[3] is None and got[4] == ""
        for part in ("Keller", "anna.k", "Smith", "0199", "4111 1111", "8.8.8.8", "0123456789abcdef", "078-05"):
            assert part not in got[1], part
        found = [(k, v) for *_, k, v in pii.entities(got[1])]
        assert [k for k, _ in found] == [k for *_, k, _ in pii.entities(text)]
        assert found[0][0] == "given" and found[0][1].lower() in pii.GIVEN["f", "latin"] and found.count(found[0]) == 2
        card = next(v for k, v in found if k == "card")
        assert pii.luhn(card.replace(" ", "")) == 0 and card[0] == "4"
        phones = [pii.canonical(k, v) for k, v in found if k == "phone"]
        assert phones[0] == phones[1]


def test_pii_surrogates_are_distinct_and_keyed():
    ips = {pii.surrogate("ip", f"1.2.{a}.{b}") for a in range(40) for b in range(40)}
    assert len(ips) == 1600
    assert pii.surrogate("email", "a.b@c.org", "one") != pii.surrogate("email", "a.b@c.org", "two")


# -- 7 top-k --------------------------------------------------------------------------------------


def slow_top_k(vectors, is_query, k):
    v = [(i, np.array([int(np.floor(64 * float(x))) for x in e], dtype=object)) for i, e in vectors if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = set()
    for i, x in v:
        if is_query(i):
            best = sorted((-int(sum(x * y)), j) for j, y in v if j != i and len(y) == len(x))[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("blocks", [(4096, topk.QUERY_BYTES), (16, 20_000)])
def test_top_k(spark, sf_dir, blocks):
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = slow_top_k([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()], lambda i: i % 20 == 0, 20)
    got = topk.top_k(cluttered(df).repartition(3), F.col("vec_id") % 20 == 0, 20, block=blocks[0], query_bytes=blocks[1])
    assert {tuple(r) for r in got.collect()} == want


def test_top_k_of_huge_scores(spark):
    ship(spark)
    r = np.random.default_rng(5)
    big = [(i, [float(x) for x in r.integers(2**23, 2**24, 3)]) for i in range(60)] + [(60, [1e7, 0.02, 0.0])] + [(61 + i, [1e7, i / 64, 0.0]) for i in range(20)]
    df = spark.createDataFrame([(i, [x * 2**i_ for x, i_ in zip(v, (0, 0, 0))]) for i, v in big], "vec_id long, embedding array<double>").repartition(3)
    want = slow_top_k(big, lambda i: i % 20 == 0, 7)
    assert max(abs(x[3]) for x in want) > 2**60
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 7, block=16).collect()} == want
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()


def test_top_k_of_odd_vectors(spark):
    ship(spark)
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, -inf]), (None, [1.0, 1.0]), (7, [-0.001, 0.0]), (8, [3.0]), (40, []), (60, [5.0, 5.0]), (9, [0.999, -2.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = slow_top_k([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in vectors], lambda i: i % 20 == 0, 3)
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 3).collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0


# -- 8 substrings ---------------------------------------------------------------------------------


def test_substrings(given):
    df, own = given
    got = rows(substrings.repeated_spans(df))
    seen = defaultdict(set)
    for d, t, _ in own:
        raw, a = (t or "").encode(), 0
        for b in brute.chunk_ends(raw):
            seen[raw[a:b]].add(d)
            a = b
    want = Counter()
    for d, t in {(d, t) for d, t, _ in own}:
        raw, a, run = (t or "").encode(), 0, None
        for b in [*brute.chunk_ends(raw), None]:
            owners = [x for x in seen[raw[a:b]] if x is not None] if b is not None else []
            if owners and (d is None or min(owners) < d):
                run = (run[0] if run else a, b)
            else:
                if run and run[1] - run[0] >= substrings.MIN_BYTES:
                    want[d, run[0], run[1] - run[0]] += 1
                run = None
            a = b
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in got) == want
    kept = rows(substrings.dedup_substrings(df))
    assert len(kept) == len(own) and all(len((r["text"] or "").encode()) - r["n_repeated"] == len(r["kept_text"].encode()) for r in kept)


def test_passages_without_white_space(spark):
    """Shared passages of a script without spaces are found about as well as others."""
    ship(spark)
    r = np.random.default_rng(7)
    text = lambda n: "".join(chr(int(c)) for c in r.integers(0x4E00, 0x9FA5, n))
    shared = [text(200) for _ in range(30)]
    docs = [(2 * i + k, text(300) + shared[i] + text(300)) for i in range(30) for k in range(2)]
    got = rows(substrings.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")))
    assert len({x["doc_id"] for x in got}) >= 29 and all(x["doc_id"] % 2 for x in got)
    for x in got:
        raw = docs[x["doc_id"]][1].encode()[x["start"] : x["start"] + x["length"]]
        assert raw.decode() in docs[x["doc_id"] - 1][1]


def test_chunks_resist_insertions():
    r = np.random.default_rng(2)
    data = r.choice(np.frombuffer(b"abcdefgh      ", dtype=np.uint8), 3 * substrings.SLICE // 2)
    cut = set(substrings.ends(data).tolist())
    moved = {x - 7 for x in substrings.ends(np.concatenate([data[:500], np.frombuffer(b"1234567", dtype=np.uint8), data[500:]])).tolist()}
    assert len({x for x in cut if x > 600} - moved) == 0


# -- 9 sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 5, 24])
def test_sharding(given, n):
    import zlib

    df, own = given
    got = rows(sharding.shard_by_bytes(df, n))
    raw = [(d, (t or "").encode()) for d, t, _ in own]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(t) + 8, zlib.crc32(t)) for d, t in raw)
    total, largest, by = sum(len(t) + 8 for _, t in raw), max(len(t) + 8 for _, t in raw), defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n))
    for s in range(n):
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - total / n) <= 2 * largest + 0.003 * total / n


@pytest.mark.parametrize("n", [5, 24])
def test_sharding_against_summed_boundaries(given, n):
    df, own = given
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in rows(sharding.shard_by_bytes(df, n)))
    import zlib

    want = brute.shards([(d, t) for d, t, _ in own], n)
    assert got == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s) for (d, t, _), s in zip(own, want))


def test_sharding_parts_a_group_of_copies(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    sizes = [r["s"] for r in rows(sharding.shard_by_bytes(df, 24).groupBy("shard").agg(F.sum("size").alias("s")))]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 24


def test_sharding_written(docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").exceptAll(docs).count() == 0 == docs.exceptAll(back.drop("shard").select(docs.columns)).count()


# -- 10 lines -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n_batches", [1, 4])
def test_lines(given, n_batches):
    df, own = given
    got = rows(lines.dedup_lines(df, n_batches=n_batches))
    want = brute.lines([(d, t) for d, t, _ in own])
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == Counter((d, *x) for (d, *_), x in zip(own, want))


# -- all ------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    ship(spark)
    labels = spark.createDataFrame([], LABELS)
    for made in (
        packing.pack(empty), mixing.mix(empty), quality.quality_rules(empty, labels), neardup.near_duplicates(empty), pii.replace_pii(empty), substrings.repeated_spans(empty), substrings.dedup_substrings(empty),
        sharding.shard_by_bytes(empty), lines.dedup_lines(empty), urls.url_filter(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")),
    ):
        assert made.count() == 0


def test_only_nulls(spark, empty):
    ship(spark)
    df = spark.createDataFrame([(None, None, None, None, None)] * 2, empty.schema)
    labels = spark.createDataFrame([(None, None, None)], LABELS)
    assert packing.pack(df).count() == 2 and mixing.mixed_documents(df).count() == 2 and quality.quality_rules(df, labels).filter("not kept").count() == 2
    assert [r["component_id"] for r in rows(neardup.near_duplicates(df))] == [None, None] and pii.replace_pii(df).count() == 2
    assert substrings.repeated_spans(df).count() == 0 and sharding.shard_by_bytes(df).count() == 2 and [r["n_lines"] for r in rows(lines.dedup_lines(df))] == [1, 1]


def test_odd_rows_are_odd():
    own = odd_rows()
    assert any(r[0] is None for r in own) and any(r[1] is None for r in own) and any(r[1] == "" for r in own) and max(len(r[1] or "") for r in own) > 200_000


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda cols, got: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in got)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(want.columns, want.fetchall())
