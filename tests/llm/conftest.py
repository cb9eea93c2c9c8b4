import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, odd characters."""
    r = random.Random(3)
    base, long_ = sentence(r, 120), sentence(r, 60_000)
    passage = sentence(r, 80)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "  ", 3), "en", "a"), (4, base.upper(), "de", None),
        (5, None, "en", "a"), (6, "", None, "b"), (7, " \t\n\x0b\x0c\r", "en", "b"), (None, base, "en", "b"), (None, None, None, None),
        (8, "x", "en", "A"), (9, "one two three", "en", "ä"), (9, "one two three four five", "en", "ä"), (10, long_, "en", "zz"), (11, "w" * 70_000, "en", "a"),
        (12, "a line of words\nA LINE OF WORDS \n\nshort\nshort\na line of words", "en", "a"), (13, "a line of words\nother line here\n", "en", "a"),
        (14, passage + "\n" + sentence(r, 60), "en", "b"), (15, sentence(r, 40) + " inserted " + passage, "en", "b"), (16, "é" * 9 + "\n" + "e\u0301 \u00a0\u2003 ﬁ ß İ 𝔘𝔫𝔦 😀😀 <|endoftext|> don't it's 3.14 #*$%&|<>", "fr", ""),
        (-5, " ".join(["same"] * 300), "en", "a"), (2**62, "a b c " * 40, "en", None), (17, "tab\tseparated\tWords " * 30, "en", "c"),
    ]
    rows += [(100 + i, sentence(r, r.randint(50, 200)), "en", r.choice("abc")) for i in range(40)]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = (
    "id n k v q a b c h d p w x m s key th fp bucket class bin rn size part end base turn words finish slot shard salt line line_no batch owner k1 k2 kept n_words score host path rule "
    "verdict mean low domain suffix ask qb cb rank start length digest stop pos root node component_id kind name made e salts sequence_id offset skey target taken n_lines n_dropped kept_text n_entities"
).split()


def cluttered(df):
    """df with extra columns whose names operators might use themselves."""
    return df.select("*", *(F.lit("extra").alias(c) for c in CLASHES if c not in df.columns))
