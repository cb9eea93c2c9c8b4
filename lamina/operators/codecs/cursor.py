"""Cursor codec: matches are told by their distance from one of two cursors in the parent.

Tokens: literal `0 byte`; match `flag, length, distance high, distance low` with length - 3 =
256 * c + the length byte and flag = 1 + 5 * c + {0 within the output, 1 main +, 2 main -, 3 second +,
4 second -}. `pack` puts tokens through one static prefix code.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

from ...functions.gear import as_array

SHORTEST, LONGEST, CHAIN = 3, 1026, 1024
SMALL, FAR, REACH = 256, 4096, 32767
LOCAL, MAIN, SECOND = 0, 1, 2


class Cursors:
    """Both start at 0. The first match moves the cursor it used; later ones too if this and the last
    distance are small, else the other cursor moves."""

    def __init__(self, main: int = 0, second: int = 0):
        self.at = {MAIN: main, SECOND: second}
        self.last: int | None = None

    def distance(self, place: int) -> tuple[int, int]:
        """(distance, cursor) from the nearer cursor, the main one if both are as near."""
        a, b = place - self.at[MAIN], place - self.at[SECOND]
        return (a, MAIN) if abs(a) <= abs(b) else (b, SECOND)

    def move(self, end: int, distance: int, cursor: int) -> None:
        if cursor != LOCAL:
            near = self.last is None or (abs(self.last) < SMALL and abs(distance) < SMALL)
            self.at[cursor if near else MAIN + SECOND - cursor] = end
        self.last = distance

    def move_simple(self, end: int, distance: int, cursor: int) -> None:
        """The rule without memory: a small distance moves the cursor used, another the other one."""
        if cursor != LOCAL:
            self.at[cursor if abs(distance) < SMALL else MAIN + SECOND - cursor] = end


def triplet_key(data: bytes, i: int) -> int:
    return data[i] << 16 | data[i + 1] << 8 | data[i + 2]


def triplet_index(data: bytes) -> dict[bytes, list[int]]:
    """Three bytes -> at most CHAIN places, ascending."""
    out: dict[bytes, list[int]] = {}
    for i in range(len(data) - 2):
        own = out.setdefault(data[i : i + 3], [])
        if len(own) < CHAIN:
            own.append(i)
    return out


def triplet_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Three bytes as a number, and how many of their places the index keeps."""
    x = as_array(data).astype(np.int64)
    keys, n = np.unique(x[:-2] << 16 | x[1:-1] << 8 | x[2:], return_counts=True)
    return keys, np.minimum(n, CHAIN)


def score(length: int, distance: int) -> int:
    return (length - (abs(distance) > FAR)) * 65536 + (0xFFFF - abs(distance))


def match_token(length: int, distance: int, cursor: int) -> bytes:
    c, rest = divmod(length - SHORTEST, 256)
    side = 0 if cursor == LOCAL else 2 * cursor - (distance >= 0)
    return bytes([1 + 5 * c + side, rest, abs(distance) >> 8, abs(distance) & 255])


def encode(parent: bytes, target: bytes) -> bytes:
    """Best-scoring match at each place, else a literal. Places farther than REACH from both cursors
    are no candidates, so distances always fit."""
    index, cursors, out, i = triplet_index(parent), Cursors(), bytearray(), 0
    while i < len(target):
        best = None
        for p in index.get(target[i : i + 3], ()):
            d, cursor = cursors.distance(p)
            if abs(d) > REACH:
                continue
            if best and parent[p : p + min(best[1] - 1, LONGEST)] != target[i : i + min(best[1] - 1, LONGEST)]:
                continue  # shorter by two or more can't score higher
            n = SHORTEST
            most = min(LONGEST, len(parent) - p, len(target) - i)
            step = 64
            while n < most:
                k = min(step, most - n)
                if parent[p + n : p + n + k] == target[i + n : i + n + k]:
                    n += k
                elif k == 1:
                    break
                else:
                    step = max(1, k // 4)
            s = score(n, d)
            if best is None or s > best[0]:
                best = (s, n, d, cursor, p)
        if best is None:
            out += bytes([0, target[i]])
            i += 1
        else:
            _, n, d, cursor, p = best
            out += match_token(n, d, cursor)
            cursors.move(p + n, d, cursor)
            i += n
    return bytes(out)


def decode(parent: bytes, delta: bytes) -> bytes:
    """Raises ValueError on a malformed delta."""
    out, cursors, i = bytearray(), Cursors(), 0
    while i < len(delta):
        flag = delta[i]
        size = 4 if flag else 2
        if flag > 20 or i + size > len(delta):
            raise ValueError("malformed token")
        if not flag:
            out.append(delta[i + 1])
        else:
            c, side = divmod(flag - 1, 5)
            n, d = 256 * c + delta[i + 1] + SHORTEST, delta[i + 2] << 8 | delta[i + 3]
            cursor = (side + 1) // 2
            if cursor == LOCAL:
                at, source = len(out) - d, bytes(out)
                d = -d
            else:
                d = d if side % 2 else -d
                at, source = cursors.at[cursor] + d, parent
            if at < 0 or at + n > len(source):
                raise ValueError("token points beyond its source")
            out += source[at : at + n]
            cursors.move(at + n, d, cursor)
        i += size
    return bytes(out)


@lru_cache(1)
def code() -> tuple[dict[int, str], dict[str, int]]:
    """Canonical prefix code of the weights 20 (bytes under 128) and 5 (others)."""
    heap = [(20 if b < 128 else 5, b, (b,)) for b in range(256)]
    heapq.heapify(heap)
    depth = dict.fromkeys(range(256), 0)
    while len(heap) > 1:
        (w1, k1, s1), (w2, k2, s2) = heapq.heappop(heap), heapq.heappop(heap)
        for b in s1 + s2:
            depth[b] += 1
        heapq.heappush(heap, (w1 + w2, min(k1, k2), s1 + s2))
    book, value, last = {}, 0, 0
    for n, b in sorted((n, b) for b, n in depth.items()):
        value <<= n - last
        book[b], last, value = format(value, f"0{n}b"), n, value + 1
    return book, {v: k for k, v in book.items()}


def pack(tokens: bytes) -> bytes:
    bits = "".join(map(code()[0].__getitem__, tokens))
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def unpack(packed: bytes) -> bytes:
    """Tokens; what padding may spell is an incomplete token, which is dropped."""
    bits, back, out, at = format(int.from_bytes(packed, "big"), f"0{8 * len(packed)}b") if packed else "", code()[1], bytearray(), 0
    sizes = sorted({len(x) for x in back})
    while True:
        for n in sizes:
            if (b := back.get(bits[at : at + n])) is not None:
                out.append(b)
                at += n
                break
        else:
            break
    i = 0
    while i < len(out) and i + (4 if out[i] else 2) <= len(out):
        i += 4 if out[i] else 2
    return bytes(out[:i])
