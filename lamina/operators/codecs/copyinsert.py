"""Copy/insert codecs.

INSERT is a 3-byte little-endian length with the top bit set, then the bytes; COPY a 3-byte length
and a 3-byte place in the parent. Lengths stay under 2**23 and places under 2**24: longer inserts and
copies are split, and parts of a parent beyond 2**24 are not copied from.
"""

from __future__ import annotations

import numpy as np

from ...functions.gear import as_array, rolling
from ..chunking import gear_ends

MAX_LEN, MAX_AT = 2**23 - 1, 2**24 - 1
BLOCK = 16


def insert(data: bytes) -> bytes:
    out = []
    for a in range(0, max(1, len(data)), MAX_LEN):
        part = data[a : a + MAX_LEN]
        out += [(len(part) | 1 << 23).to_bytes(3, "little"), part]
    return b"".join(out)


def copy(length: int, at: int) -> bytes:
    out = []
    while length:
        n = min(length, MAX_LEN)
        out += [n.to_bytes(3, "little"), at.to_bytes(3, "little")]
        length, at = length - n, at + n
    return b"".join(out)


def decode(parent: bytes, delta: bytes) -> bytes:
    """Raises ValueError on a malformed delta."""
    out, i = [], 0
    while i < len(delta):
        head = int.from_bytes(delta[i : i + 3], "little")
        n, literal = head & MAX_LEN, head >> 23
        i += 3
        if literal:
            part = delta[i : i + n]
            i += n
        else:
            at = int.from_bytes(delta[i : i + 3], "little")
            part = parent[at : at + n]
            i += 3
        if len(part) != n or i > len(delta):
            raise ValueError("delta points beyond its data")
        out.append(part)
    return b"".join(out)


def common(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common run of a from i and b from j."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 32
    while n < most:
        k = min(step, most - n)
        if a[i + n : i + n + k] == b[j + n : j + n + k]:
            n += k
            step *= 2
        elif k == 1:
            break
        else:  # the difference is within k bytes
            x = int.from_bytes(a[i + n : i + n + k], "little") ^ int.from_bytes(b[j + n : j + n + k], "little")
            return n + ((x & -x).bit_length() - 1) // 8
    return n


def _windows(data: bytes) -> np.ndarray:
    """64-bit gear hashes of the 16 bytes that start at each place."""
    return rolling(as_array(data), BLOCK, shift=4, dtype=np.uint64)[BLOCK - 1 :]


def encode_gear(parent: bytes, target: bytes) -> bytes:
    """Greedy matches of 16 bytes or more, found by the top bits of a 16-byte gear hash; of places with
    equal bits the last counts. Ends with one INSERT, which may be empty."""
    if min(len(parent), len(target)) < BLOCK:
        return insert(target)
    own = _windows(parent[: MAX_AT + 1])
    shift = np.uint64(64 - max(1, int(len(parent)).bit_length() - 1))
    table = np.full(1 << int(64 - int(shift)), -1, dtype=np.int64)
    table[(own >> shift).astype(np.int64)] = np.arange(len(own))
    theirs = _windows(target)
    cand = table[(theirs >> shift).astype(np.int64)]
    # only places whose whole 64-bit hash agrees can match 16 bytes
    good = np.flatnonzero((cand >= 0) & (own[np.maximum(cand, 0)] == theirs))
    out, done, k = [], 0, 0
    while k < len(good):
        i = int(good[k])
        n = common(parent, int(cand[i]), target, i)
        if n < BLOCK:
            k += 1
            continue
        if i > done:
            out.append(insert(target[done:i]))
        out.append(copy(n, int(cand[i])))
        done = i + n
        k = int(np.searchsorted(good, done))
    return b"".join([*out, insert(target[done:])])


def block_sums(data: bytes) -> np.ndarray:
    """Adler sums (high * 65536 + low) of the 16 bytes that start at each place. Sums of 16 bytes stay
    under the modulus, so none is taken."""
    x = as_array(data).astype(np.int64)
    if len(x) < BLOCK:
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate([[0], np.cumsum(x)])
    weighted = np.concatenate([[0], np.cumsum(x * np.arange(len(x)))])
    i = np.arange(len(x) - BLOCK + 1)
    low = c[i + BLOCK] - c[i]
    # sum of (16 - k) * x[i + k] = (16 + i) * sum - sum of place * x
    high = (BLOCK + i) * low - (weighted[i + BLOCK] - weighted[i])
    return (high + BLOCK) * 65536 + low + 1


def block_index(data: bytes) -> dict[int, list[int]]:
    """Block sum -> all places, ascending."""
    sums = block_sums(data)
    order = np.argsort(sums, kind="stable")
    cut = np.flatnonzero(np.diff(sums[order])) + 1
    return {int(sums[g[0]]): g.tolist() for g in np.split(order, cut)} if len(sums) else {}


def block_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Block sums and the number of their places."""
    return np.unique(block_sums(data), return_counts=True)


def encode_blocks(parent: bytes, target: bytes) -> bytes:
    """Block-sum matching: at a place whose block sum the parent has, the longest run over all its
    places (the first of equals); else bytes are inserted up to the next known block."""
    own, sums = block_sums(parent[: MAX_AT + 1]), block_sums(target)
    order = np.argsort(own, kind="stable")  # places by sum, ascending among equals
    first, last = (np.searchsorted(own[order], sums, side=side) for side in ("left", "right"))
    hits = np.flatnonzero(last > first)
    out, i = [], 0
    while i < len(target):
        k = int(np.searchsorted(hits, i))
        at = int(hits[k]) if k < len(hits) else len(target)
        if at > i:
            out.append(insert(target[i:at]))
            i = at
            continue
        best, where = 0, 0
        for p in order[first[i] : last[i]].tolist():
            if best and parent[p + best : p + best + 1] != target[i + best : i + best + 1]:
                continue  # can't be longer
            n = common(parent, p, target, i)
            if n > best:
                best, where = n, p
            if i + best == len(target):
                break
        if best:
            out.append(copy(best, where))
            i += best
        else:
            out.append(insert(target[i : i + BLOCK]))
            i += BLOCK
    return b"".join(out)


def _pieces(data: bytes) -> list[tuple[int, int]]:
    ends = gear_ends(data).tolist()
    return list(zip([0, *ends], ends))


def piece_index(data: bytes) -> dict[bytes, int]:
    """Content-defined piece -> its first place."""
    out: dict[bytes, int] = {}
    for a, b in _pieces(data[: MAX_AT + 1]):
        out.setdefault(data[a:b], a)
    return out


def encode_pieces(parent: bytes, target: bytes) -> bytes:
    """Each content-defined piece of the target is a COPY if the parent has it whole, else an INSERT."""
    index = piece_index(parent)
    return b"".join(copy(b - a, index[target[a:b]]) if target[a:b] in index else insert(target[a:b]) for a, b in _pieces(target))


def encode_extended(parent: bytes, target: bytes, learn: bool) -> bytes:
    """Like encode_pieces, but a match goes on byte by byte beyond its piece, over the pieces after; of
    a piece that it ends in, the rest is tried as a piece. With `learn`, what matched beyond its piece
    is a piece of the parent from then on."""
    index, ends = piece_index(parent), gear_ends(target)
    out, i = [], 0
    while i < len(target):
        end = int(ends[np.searchsorted(ends, i, side="right")])
        at = index.get(target[i:end])
        if at is None:
            out.append(insert(target[i:end]))
            i = end
            continue
        n = (end - i) + common(parent, at + end - i, target, end)
        if learn and n > end - i:
            index.setdefault(target[i : i + n], at)
        out.append(copy(n, at))
        i += n
    return b"".join(out)
