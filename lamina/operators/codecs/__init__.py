"""Delta codecs: encode(parent, target) -> bytes, decode(parent, delta) -> target; all lossless."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ...functions.parts import in_parts
from . import copyinsert, cursor, edits


@dataclass(frozen=True)
class Codec:
    """encode returns None where a chunk is better stored in full."""

    name: str
    encode: Callable[[bytes, bytes], bytes | None]
    decode: Callable[[bytes, bytes], bytes]
    compressed: bool = False


_PLAIN = [
    Codec("gdelta", copyinsert.encode_gear, copyinsert.decode),
    Codec("xdelta", copyinsert.encode_blocks, copyinsert.decode),
    Codec("ddelta", copyinsert.encode_pieces, copyinsert.decode),
    Codec("edelta_speed", lambda p, t: copyinsert.encode_extended(p, t, learn=False), copyinsert.decode),
    Codec("edelta_ratio", lambda p, t: copyinsert.encode_extended(p, t, learn=True), copyinsert.decode),
    Codec("zdelta", cursor.encode, cursor.decode),
    Codec("zdelta_huff", lambda p, t: cursor.pack(cursor.encode(p, t)), lambda p, d: cursor.decode(p, cursor.unpack(d))),
    Codec("edit", edits.encode, edits.decode),
]


def _zstd(codec: Codec) -> Codec:
    def encode(parent, target):
        made = codec.encode(parent, target)
        return None if made is None else zstandard.ZstdCompressor().compress(made)

    return Codec(codec.name + "_zstd", encode, lambda p, d: codec.decode(p, zstandard.ZstdDecompressor().decompress(d)), True)


CODECS = {c.name: c for c in _PLAIN} | {c.name: c for c in map(_zstd, (_PLAIN[0], _PLAIN[1], _PLAIN[-1]))}


def codec(name: str) -> Codec:
    if name not in CODECS:
        raise ValueError(f"unknown codec {name!r}; one of {', '.join(sorted(CODECS))}")
    return CODECS[name]


def _mapped(f, columns: list[str], kind: pa.DataType):
    def run(batches):
        for batch in in_parts(batches, *columns):
            made = [f(*(x or b"" for x in row)) for row in zip(*(batch[c].to_pylist() for c in columns))]
            rest = [n for n in batch.schema.names if n not in columns]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), pa.array(made, kind)], names=[*rest, "made"])

    return run


def by_row(df: DataFrame, f: Callable, columns: list[str], kind: str, arrow: pa.DataType) -> DataFrame:
    """df without the binary `columns`, plus `made`: f of them, null taken as empty. A narrow map."""
    rest = "".join(f"{x.name} {x.dataType.simpleString()}, " for x in df.schema if x.name not in columns)
    return df.mapInArrow(_mapped(f, columns, arrow), f"{rest}made {kind}")


def edit_distances(pairs: DataFrame) -> DataFrame:
    """pairs (…, a, b) -> (…, distance): bytes replaced, added and deleted at least."""
    return by_row(pairs, edits.distance, ["a", "b"], "long", pa.int64()).withColumnRenamed("made", "distance")


#: Rows that a map over the places of a text yields at once.
ROWS = 1 << 16


def _counted(f):
    def run(batches):
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "data"]

            def out(made, batch=batch, rest=rest):
                at = pa.array(np.repeat([i for i, _, _ in made], [len(k) for _, k, _ in made]).astype(np.int64))
                cols = [batch[n].take(at) for n in rest] + [pa.array(np.concatenate([x[k] for x in made]), pa.int64()) for k in (1, 2)]
                return pa.RecordBatch.from_arrays(cols, names=[*rest, "key", "n"])

            made, rows = [], 0
            for i, data in enumerate(batch["data"]):
                keys, n = f(data.as_py() or b"")
                for a in range(0, len(keys), ROWS):
                    made.append((i, keys[a : a + ROWS], n[a : a + ROWS]))
                    rows += len(made[-1][1])
                    if rows >= ROWS:
                        yield out(made)
                        made, rows = [], 0
            if made:
                yield out(made)

    return run


def _counts(rows: DataFrame, f: Callable) -> DataFrame:
    """A row for each key that f finds in a text, some ROWS at once: a text has as many keys as bytes,
    so those of a whole batch of texts don't fit a worker."""
    rest = "".join(f"{x.name} {x.dataType.simpleString()}, " for x in rows.schema if x.name != "data")
    return rows.mapInArrow(_counted(f), f"{rest}key long, n long")


def block_indexes(rows: DataFrame) -> DataFrame:
    """rows (…, data) -> (…, key, n): block sums of 16 bytes and the number of their places."""
    return _counts(rows, copyinsert.block_counts)


def triplet_indexes(rows: DataFrame) -> DataFrame:
    """rows (…, data) -> (…, key, n): three-byte keys and the number of their places that are kept."""
    return _counts(rows, cursor.triplet_counts)
