"""The gear table and rolling gear hashes over numpy arrays."""

from __future__ import annotations

import hashlib

import numpy as np

#: 256 fixed 64-bit numbers, one a byte value, drawn from a digest: the same in every process.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "big") for b in range(256)], dtype=np.uint64)


def rolling(data: np.ndarray, window: int, shift: int = 1, dtype=np.uint32) -> np.ndarray:
    """Gear hash of up to `window` (a power of two) bytes that end at each place.

    With shift s, the hash of 2w bytes is that of the last w plus 2**(s*w) times that of the w
    before; a b-bit hash forgets what is b / s bytes back, as the endless rolling form does.
    """
    h = GEAR.astype(dtype)[data]
    w = 1
    while w < window:
        h[w:] += h[:-w] << dtype(shift * w)
        w *= 2
    return h


def as_array(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=np.uint8)


def gear_sql(bits: int) -> list[int]:
    """The table modulo 2**bits, for SQL text."""
    return [int(g) % 2**bits for g in GEAR]
