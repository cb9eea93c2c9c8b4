"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stage, words

SYMBOL = r"[#*$%&|<>]"
#: Words of a window that counts as repeated.
WINDOW = 3
#: Buckets of each n-gram order, least and most; between the two one for each BUCKET_BYTES of text.
BUCKETS, BUCKET_BYTES = (1 << 13, 1 << 18), 1 << 15
ORDERS = (1, 2)
#: Bits of the table that tells which ids may be trusted, least and most; in between 16 to 32 an id.
MAYBE_BITS = (1 << 16, 1 << 25)
#: Share of the trusted documents that the threshold may reject.
REJECT = 0.005
STEP = 10_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all good, not toxic documents."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def dealt(df: DataFrame, trusted: DataFrame, bits: tuple[int, int] = MAYBE_BITS) -> tuple[DataFrame, DataFrame]:
    """df's doc_id and text in two parts: rows whose id may be trusted, with `trusted` (true or null),
    and the others.

    A bitmap of the ids' hashes deals them, so that few other texts move to the join; more ids than it
    has room for let more through. The join is exact and never a broadcast: labels grow with documents.
    """
    size = max(bits[0], min(bits[1], 1 << (16 * trusted.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(size))  # the same for ids of any type
    at, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    set_ = trusted.select(at.alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m")).groupBy("i").agg(F.bit_or("m").alias("m"))
    all_ = df.sparkSession.range(size // 64).select(F.col("id").alias("i")).join(set_, "i", "left").na.fill(0)
    table = stage(all_.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("x")).select(F.col("x.m").alias("m")), "trusted-bits")
    maybe = F.col("doc_id").isNotNull() & (F.getbit(F.get(table.scalar(), at.cast("int")), bit) == 1)
    rows = df.select("doc_id", "text")
    met = rows.filter(maybe).join(trusted.withColumn("trusted", F.lit(True)).hint("merge"), "doc_id", "left")
    return stage(met, "maybe-trusted"), rows.filter(~maybe)


def _bucket(h: Column, k: int, buckets: int) -> Column:
    """Bucket of an n-gram's hash; orders have ranges of their own, k numbers them."""
    at = F.pmod(h, F.lit(buckets))
    return (at + F.lit(buckets * k) if k else at).cast("int")


def _grams(df: DataFrame, orders: tuple, buckets: int) -> DataFrame:
    """half, b: one row for each n-gram of df's texts, b its bucket.

    Rows of words side by side, not arrays of hashes: Spark compiles these expressions, while it
    interprets those on array elements, at several times the cost.
    """
    top = max(orders)
    after = lambda n: F.slice("__w", n, F.greatest(F.size("__w") - (n - 1), F.lit(0)))
    beside = F.arrays_zip(*(after(n).alias(f"w{n}") for n in range(1, top + 1)))  # null past the text's end
    each = df.select("half", words(F.col("text")).alias("__w")).select("half", F.explode(beside).alias("p"))
    first = lambda n: F.when(F.col(f"p.w{n}").isNotNull(), F.xxhash64(f"p.w{n}"))
    each = each.select("half", *(first(n).alias(f"h{n}") for n in range(1, top + 1)))
    run, parts = F.col("h1"), []
    for n in range(1, top + 1):
        if n > 1:  # an n-gram's hash: that of the one before and of its last word
            run = F.when(F.col(f"h{n}").isNotNull(), F.xxhash64(run, F.col(f"h{n}")))
        if n in orders:
            parts.append(_bucket(run, len(parts), buckets))
    return each.select("half", F.explode(F.array(*parts)).alias("b")).filter("b is not null")


def _hashes(df: DataFrame, top: int) -> DataFrame:
    """df, which has its words as __w, with the hashes of all its n-grams up to n = top as __1, __2 and so on."""
    df = df.withColumn("__1", F.transform("__w", lambda x: F.xxhash64(x)))
    for n in range(2, top + 1):  # as in _grams
        fit_ = F.greatest(F.size("__1") - (n - 1), F.lit(0))
        df = df.withColumn(f"__{n}", F.zip_with(F.slice(f"__{n - 1}", 1, fit_), F.slice("__1", n, fit_), lambda x, y: F.xxhash64(x, y)))
    return df


def buckets_for(df: DataFrame) -> int:
    """Buckets of each order for the texts of df: a power of two that grows with them."""
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(BUCKETS[0], min(BUCKETS[1], 1 << max(0, (size // BUCKET_BYTES).bit_length() - 1)))


def _statistics(df: DataFrame, top: int = WINDOW) -> DataFrame:
    """df with its statistics, words (__w) and the hashes of n-grams (see _hashes)."""
    text, n = F.coalesce(F.col("text"), F.lit("")), F.size("__w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    less = lambda c, k: F.slice(c, k, F.greatest(F.size(c) - 1, F.lit(0)))
    out = df.withColumn("__w", words(F.col("text"))).withColumn("n_words", n.cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
    out = out.withColumn("__l", lines).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).drop("__l")
    out = _hashes(out, max(top, WINDOW))
    # windows side by side in the order of their hashes: equal neighbours are the repeated ones
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__3")) < F.size("__3"), F.sort_array(F.transform("__3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.zip_with(less(F.col("__s"), 1), less(F.col("__s"), 2), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(twin, lambda x: x.isNotNull()))))
    out = out.withColumn("n_repeat_words", F.when(F.col("__s").isNull(), 0).otherwise(covered).cast("long")).drop("__s")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def fit(met: DataFrame, rest: DataFrame, orders: tuple, buckets: int) -> DataFrame:
    """One row: w0, w1, the log ratios of all buckets, target over raw corpus. met, rest: see `dealt`.

    The raw multinomial counts all rows, the target all trusted ones. These go to two halves by id; w0
    has the target multinomial of the half 1 and serves the documents of the half 0, w1 the other
    way, so that no document is scored by counts of its own.
    """
    half = F.when(F.col("trusted"), F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    rows = met.select("text", half.alias("half")).unionByName(rest.select("text", F.lit(None).cast("long").alias("half")))
    each = _grams(rows, orders, buckets)
    count = lambda c: F.count(F.when(c, 1))
    seen = each.groupBy("b").agg(F.count(F.lit(1)).alias("q"), count(F.col("half") == 1).alias("p0"), count(F.col("half") == 0).alias("p1"))
    seen = stage(seen, "gram-counts")
    all_ = rest.sparkSession.range(buckets * len(orders)).select(F.col("id").cast("int").alias("b")).join(seen, "b", "left").na.fill(0)
    of_order = Window.partitionBy(F.floor(F.col("b") / buckets))
    raw = all_.withColumn("raw", (F.col("q") + 1) / F.sum(F.col("q") + 1).over(of_order))
    # the target's prior is the raw share, worth as many grams as buckets: what it never saw counts against a text
    share = lambda c: (F.col(c) + buckets * F.col("raw")) / (F.sum(c).over(of_order) + buckets)
    ratio = raw.select("b", *(F.round(F.log(share(p) / F.col("raw")), 6).alias(w) for p, w in (("p0", "w0"), ("p1", "w1"))))
    got = ratio.agg(F.array_sort(F.collect_list(F.struct("b", "w0", "w1"))).alias("w"))  # as many rows as buckets
    return got.select(F.col("w.w0").alias("w0"), F.col("w.w1").alias("w1"))


def _scored(df: DataFrame, weights: DataFrame, orders: tuple, buckets: int) -> DataFrame:
    mine = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, weights.select("w0").scalar()).otherwise(weights.select("w1").scalar())
    out = _statistics(df, max(orders)).withColumn("__m", mine)
    weight = lambda k: lambda a, h: a + F.get(F.col("__m"), _bucket(h, k, buckets))
    total, n = F.lit(0.0), F.lit(0)
    for k, order in enumerate(sorted(set(orders))):
        total, n = F.aggregate(f"__{order}", total, weight(k)), n + F.size(f"__{order}")
    out = out.withColumn("score", F.when(n > 0, F.round(total / n, 6)))
    # a generator of one row: filters on the results stop here, instead of spelling out all of the above
    made = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
    return out.select(*df.columns, F.explode(F.array(made)).alias("__r")).select(*df.columns, "__r.*")


def quality_rules(df: DataFrame, labels: DataFrame, orders: tuple = ORDERS, buckets: int | None = None, reject: float = REJECT) -> DataFrame:
    """df's columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    score: mean over the text's n-grams of log(target share / raw share) of their hash buckets. The
    target is all documents labelled good, the raw corpus all of df; the buckets grow with the
    corpus, up to a bound, since every worker holds their weights. kept: not base_failed and score at least the threshold, the score that `reject` of the trusted documents
    stay under (to 1 / STEP); without trusted documents only the base rules count.

    Three-word windows are compared by 64 bits of hash. Null or empty text has no words and fails
    the base rules; a null id is scored like others but can't be trusted; repeated rows get the same
    verdict. An empty table gives no rows. Columns of the names above are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    df = df.drop(*made)
    buckets = buckets or buckets_for(df)
    met, rest = dealt(df, stage(trusted_ids(labels), "trusted"))
    weights = stage(fit(met, rest, orders, buckets), "gram-weights")
    bins = _scored(met.filter("trusted").select("doc_id", "text"), weights, orders, buckets).filter(~F.col("base_failed")).groupBy(F.floor(F.col("score") * STEP).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    upto = bins.select("s", F.sum("n").over(Window.orderBy("s")).alias("c"), F.sum("n").over(Window.partitionBy()).alias("all"))
    least = stage(upto.filter(F.col("c") > reject * F.col("all")).agg((F.min("s") / STEP).alias("t")), "threshold").scalar()
    scored = _scored(df, weights, orders, buckets)
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= least, F.lit(True)))
