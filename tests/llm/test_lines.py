"""White space at the ends of lines: the form feed, and the letter f, which is none."""

from collections import Counter

from lamina import ship
from lamina.llm import lines

from . import brute


def test_form_feeds_and_the_letter_f(spark):
    ship(spark)
    texts = ["found here\nhere is of\nstay off\nf234567890\nendings off", "found here\nhere is of\nstay o\n\x0cf234567890\x0c\nendings o", "FOUND HERE\x0c\n234567890\nsound of it", "\x0c\x0csound of it\nff ff ff ff", "ff ff ff ff\x0c \x0c\n"]
    own = [*enumerate(texts)]
    got = lines.dedup_lines(spark.createDataFrame(own, "doc_id long, text string"), n_batches=2).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == Counter((d, *x) for (d, _), x in zip(own, brute.lines(own)))
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {0: 0, 1: 3, 2: 1, 3: 1, 4: 1}
