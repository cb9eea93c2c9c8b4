"""Byte codecs: golden tokens, the scenario family, small and large inputs, malformed deltas."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.operators import codecs
from lamina.operators.codecs import CODECS, codec, copyinsert, cursor, edits

R = random.Random(5)
BASE = R.randbytes(8192)
RAMP = bytes(i % 256 for i in range(9108))
BIG = R.randbytes(70_000)


def changed(data, *places):
    out = bytearray(data)
    for p in places:
        out[p] = (out[p] + 101) % 256
    return bytes(out)


CASES = {
    "one byte": (changed(BASE, 15), BASE),
    "two adjacent": (changed(BASE, 15, 16), BASE),
    "two distant": (changed(BASE, 15, 106), BASE),
    "left offset": (BASE, BASE[15:]),
    "truncated": (BASE, BASE[:8000]),
    "both and edits": (BASE, changed(BASE[15:8000], 0, 7000)),
    "tail appended": (BASE, BASE + BASE[8000:]),
    "head prepended": (BASE, BASE[:192] + BASE),
    "equal": (BASE, BASE),
    "ramp rotated": (RAMP, RAMP[500:] + RAMP[:500]),
    "ramp cut": (RAMP, RAMP[100:-100]),
    "three edits": (BASE, changed(BASE, 15, 1000, 5000)),
    "middle with edits": (BASE, changed(BASE[1000:6000], 20, 3000)),
    "every hundredth": (BASE, changed(BASE, *range(0, 8192, 100))),
    "five bytes": (b"\1\2\3\4\5", b"\1\2\3\4\6"),
    "parent 32767": (BIG[:32767], changed(BIG[:32767], 5, 30000)),
    "parent 32768": (BIG[:32768], changed(BIG[:32768], 5, 30000)),
    "parent 70000": (BIG, changed(BIG, 5, 30000, 69000)),
    "far places": (BIG, BIG[60000:] + BIG[:20000]),
    "match at parent's end, more target": (BASE, BASE[4000:] + b"more"),
    "constant": (bytes(9000), bytes(9100)),
    "nothing in common": (BASE, BIG[:5000]),
} | {f"small {n}": (BASE[:n], BASE[: n + 1]) for n in (0, 1, 2, 3, 14, 15, 16, 17)} | {f"smaller {n}": (BASE[: n + 1], BASE[:n]) for n in (0, 1, 14, 15, 16)}


@pytest.mark.parametrize("name", CODECS)
@pytest.mark.parametrize("case", CASES)
def test_roundtrip(name, case):
    parent, target = CASES[case]
    made = codec(name).encode(parent, target)
    assert made is None and name.startswith("edit") or codec(name).decode(parent, made) == target


text = st.lists(st.sampled_from([b"alpha ", b"beta ", b"\0\0\0", b"gamma", b"x"]), max_size=60).map(b"".join)


@settings(max_examples=40, deadline=None)
@given(text, text, st.sampled_from(sorted(CODECS)))
def test_roundtrip_of_any_texts(parent, target, name):
    made = codec(name).encode(parent, target)
    assert made is None or codec(name).decode(parent, made) == target


def test_near_copies_shrink():
    for name in CODECS:
        made = codec(name).encode(BASE, changed(BASE, 4000))
        assert made is not None and len(made) < (9000 if name.startswith(("ddelta", "edelta")) else 400)


def test_copyinsert_tokens():
    assert copyinsert.insert(b"x" * 20)[:3] == bytes([20, 0, 0x80])
    assert copyinsert.insert(b"12345")[:3] == bytes([5, 0, 0x80])
    assert copyinsert.copy(32, 0) == bytes([32, 0, 0, 0, 0, 0])
    equal = copyinsert.encode_gear(BASE, BASE)
    assert len(equal) < 30 and equal[-3:] == bytes([0, 0, 0x80])  # a slot of the index may be taken over
    short = copyinsert.encode_gear(BASE[:16], BASE[:16])
    assert short == copyinsert.copy(16, 0) + copyinsert.insert(b"")
    shifted = copyinsert.encode_blocks(b"abcdefghijklmnopqrstuvwxyzABCDEF", b"ijklmnopqrstuvwxyzABCDEFGHIJKL")
    assert shifted[:6] == bytes([24, 0, 0, 8, 0, 0])
    index = copyinsert.block_index(b"abcd" * 8)
    assert len(index) == 3 and [0, 4, 8, 12, 16] in index.values()


def test_cursor_tokens_and_rules():
    assert cursor.match_token(10, 100, cursor.MAIN) == bytes([2, 7, 0, 100])
    assert cursor.match_token(300, -1024, cursor.SECOND) == bytes([10, 41, 4, 0])
    for n, want in ((259, (0, 1)), (514, (255, 1)), (1024, (253, 3)), (1026, (255, 3))):
        token = cursor.match_token(n, 0, cursor.MAIN)
        assert (token[1], (token[0] - 1) // 5) == want
    assert cursor.decode(b"abcd", b"\0X\2\1\0\0\0Y") == b"XabcdY"
    assert cursor.triplet_index(b"abcabcabc") == {b"abc": [0, 3, 6], b"bca": [1, 4], b"cab": [2, 5]}

    def moved(last, end, d, which):
        c = cursor.Cursors(200, 300)
        c.last = last
        c.move(end, d, which)
        return c.at[cursor.MAIN], c.at[cursor.SECOND]

    assert moved(None, 400, 200, cursor.MAIN) == (400, 300)
    assert moved(30, 250, 50, cursor.MAIN) == (250, 300)
    assert moved(40, 350, 50, cursor.SECOND) == (200, 350)
    assert moved(50, 500, 300, cursor.MAIN) == (200, 500)
    assert moved(60, 600, 300, cursor.SECOND) == (600, 300)
    assert moved(-200, 2500, -500, cursor.MAIN) == (200, 2500)
    assert cursor.Cursors(200, 300).distance(250) == (50, cursor.MAIN)
    assert cursor.Cursors(200, 300).distance(310) == (10, cursor.SECOND)
    simple = cursor.Cursors(200, 300)
    simple.move_simple(500, cursor.SMALL, cursor.MAIN)
    assert simple.at == {cursor.MAIN: 200, cursor.SECOND: 500}


def test_prefix_code_is_free_of_prefixes_and_packs():
    book = cursor.code()[0]
    spelled = sorted(book.values())
    assert len(book) == 256 and not any(b.startswith(a) for a, b in zip(spelled, spelled[1:]))
    for n in range(9):
        tokens = b"\0a" * n + b"\2\7\0\1"
        assert cursor.unpack(cursor.pack(tokens)) == tokens


def test_edit_words():
    assert edits.encode(b"abcdefgh" * 4, b"abcdefgh" * 3 + b"abXdefgh") == (0 << 30 | ord("X") << 22 | 26).to_bytes(4, "big")
    assert edits.encode(BASE, BIG[:8192]) is None
    assert edits.encode(BASE, BASE + bytes(5000)) is None


@pytest.mark.parametrize("bad", [b"\5\0\x80ab", b"\5\0\0\xff\0\0", b"\1"])
def test_malformed_copyinsert(bad):
    with pytest.raises(ValueError):
        copyinsert.decode(b"abc", bad)


@pytest.mark.parametrize("bad", [b"\x15\0\0\0", b"\2\0", b"\2\xff\0\0", b"\0"])
def test_malformed_cursor(bad):
    with pytest.raises(ValueError):
        cursor.decode(b"abc", bad)


@pytest.mark.parametrize("bad", [b"\0", b"\xc0\0\0\0", b"\0\0\0\x09"])
def test_malformed_edits(bad):
    with pytest.raises(ValueError):
        edits.decode(b"abc", bad)


def test_unknown_codec():
    with pytest.raises(ValueError):
        codec("nope")


def test_counts_of_places_are_the_indexes_and_come_in_parts():
    """The rows of many texts are never held at once."""
    import pyarrow as pa

    texts = [b"", b"ab", b"abc" * 700, bytes(3000), *(R.randbytes(30_000) for _ in range(12))]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "data": texts})
    for counts, index in ((codecs.copyinsert.block_counts, copyinsert.block_index), (codecs.cursor.triplet_counts, lambda d: {int.from_bytes(k, "big"): at for k, at in cursor.triplet_index(d).items()})):
        parts = list(codecs._counted(counts)([batch]))
        assert max(len(p) for p in parts) < 2 * codecs.ROWS and len(parts) > 3
        got = sorted(zip(*(sum((p[c].to_pylist() for p in parts), []) for c in ("doc_id", "key", "n"))))
        assert got == sorted((i, k, len(at)) for i, d in enumerate(texts) for k, at in index(d).items())


def test_blocks_are_looked_up_without_an_index_of_objects(monkeypatch):
    """An object for each block of the parent took nearly all of the time."""
    monkeypatch.setattr(copyinsert, "block_index", None)
    for parent, target in ((BASE, changed(BASE, 15, 1000)), (bytes(500), bytes(700)), (BASE[:20], BASE[:10]), (b"", BASE)):
        assert copyinsert.decode(parent, copyinsert.encode_blocks(parent, target)) == target


def _plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_goes_over_the_shorter_text_and_no_bound_is_above_it(monkeypatch):
    r, steps, went = random.Random(6), edits._steps, []
    monkeypatch.setattr(edits, "_steps", lambda a, b: went.append(len(a) >= len(b)) or steps(a, b))
    for _ in range(150):
        a = bytes(r.choices(b"abc", k=r.randrange(60)))
        b = bytes(r.choices(b"abcd", k=r.randrange(90))) if r.random() < 0.5 else a[: r.randrange(60)] + a[r.randrange(30) :]
        d = _plain_distance(a, b)
        assert edits.distance(a, b) == d and edits._least(a, b) <= d
    assert all(went) and edits._least(R.randbytes(3000), R.randbytes(3000)) > 750  # no script is tried there
