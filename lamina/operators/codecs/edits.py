"""Edit-script codec: unit-cost edits as big-endian 32-bit words, 2 bits action (0 replace, 1 add,
2 delete), 8 bits byte, 22 bits place in the parent. Scripts run from the end to the start, so that
places stay those of the parent."""

from __future__ import annotations

import numpy as np

from ...functions.gear import as_array
from .copyinsert import common

GAP, PLACES = 4000, 1 << 22
#: Distances up to this are found edit by edit, larger ones by halving; the scripts are as short.
NEAR = 48


def trimmed(a: bytes, b: bytes) -> tuple[int, int]:
    """Lengths of the common head and of the common tail after it."""
    head = common(a, 0, b, 0)
    tail = common(a[head:][::-1], 0, b[head:][::-1], 0)
    return head, tail


def script(a: bytes, b: bytes, most: int) -> list[tuple[int, int, int]] | None:
    """Edits (action, byte, place in a) from a to b, last place first; None if over `most`.

    Furthest-reaching points: for each number of edits and each diagonal (place in b less place in a),
    how far in a one gets; after an edit, equal bytes are free.
    """
    goal = len(b) - len(a)
    reach = {0: common(a, 0, b, 0)}
    rounds = [reach]
    e = 0
    while reach.get(goal, -1) < len(a):
        e += 1
        if e > most:
            return None
        new = {}
        for k in range(-e, e + 1):
            # replace stays on the diagonal, add comes from the one below, delete from the one above
            far = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            far = min(far, len(a), len(b) - k)
            if far >= 0 and far + k >= 0:
                new[k] = far + common(a, far, b, far + k)
        reach = new
        rounds.append(reach)
    out, k, x = [], goal, len(a)
    for e in range(e, 0, -1):
        before = rounds[e - 1]
        options = ((before.get(k, -2) + 1, 0, k), (before.get(k - 1, -2), 1, k - 1), (before.get(k + 1, -2) + 1, 2, k + 1))
        # the move that the furthest point came by; points past an end were clipped to it
        far, action, nk = max(options, key=lambda o: o[0])
        for o in options:
            px = before.get(o[2])
            if px is None:
                continue
            ox = px + (o[1] != 1)
            if ox == min(far, len(a), len(b) - k) and ox <= x and ox <= len(a) and 0 <= ox + k <= len(b):
                far, action, nk = o
                break
        place = before[nk]
        out.append((action, 0 if action == 2 else b[place + nk], place))
        k, x = nk, place
    return out


def _steps(a: bytes, b: bytes) -> tuple[int, int]:
    """Where the distances from the heads of a to all of b rise and where they fall by one, as bits.

    A column of the table of distances is kept as these two sets of bits, and moves on a byte of b at a
    time by arithmetic on whole numbers of len(a) bits: len(a) * len(b) / 64 steps, memory for one
    column."""
    full = (1 << len(a)) - 1
    at: dict[int, int] = {}
    x = np.frombuffer(a, dtype=np.uint8)
    for c in set(a) & set(b):
        at[c] = int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little")
    up, down = full, 0
    for c in b:
        equal = at.get(c, 0)
        keep = equal | down
        carry = (((equal & up) + up) ^ up) | equal
        rise = (down | (full & ~(carry | up))) << 1 | 1
        up = ((up & carry) << 1 | ~(keep | rise)) & full
        down = rise & keep
    return up, down


def _column(a: bytes, b: bytes) -> np.ndarray:
    """Distances from each head of a (the empty one first) to all of b."""
    n, (up, down) = len(a), _steps(a, b)
    bits = lambda v: np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n].astype(np.int64)
    return np.concatenate([[len(b)], len(b) + np.cumsum(bits(up) - bits(down))])


def distance(a: bytes, b: bytes) -> int:
    """Least number of replaced, added and deleted bytes between a and b. The longer one is the column:
    a step costs about as much for few bits as for some thousands."""
    head, tail = trimmed(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    up, down = _steps(a, b)
    return len(b) + up.bit_count() - down.bit_count()


def _least(a: bytes, b: bytes) -> int:
    """A bound that no distance is under: by lengths, by the bytes' counts, and by the counts of runs of
    three bytes, of which an edit changes six at most. Runs that share a bucket only lower it."""
    x, y = as_array(a), as_array(b)
    d = np.bincount(x, minlength=256) - np.bincount(y, minlength=256)
    least = int(max(d[d > 0].sum(), -d[d < 0].sum()))
    if min(len(x), len(y)) >= 256:  # else the counts cost more than they spare
        runs = lambda v: np.bincount((v[:-2].astype(np.int64) * 4027 + v[1:-1].astype(np.int64) * 61 + v[2:]) & 16383, minlength=16384)
        least = max(least, -(-int(np.abs(runs(x) - runs(y)).sum()) // 6))
    return least


def halved(a: bytes, b: bytes) -> list[tuple[int, int, int]]:
    """A shortest script of any length in memory for one column: b is halved, and a is cut where the
    distances of the two parts add up to the least."""
    head, tail = trimmed(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a:
        return [(1, c, head) for c in reversed(b)]
    if not b:
        return [(2, 0, head + i) for i in range(len(a) - 1, -1, -1)]
    if _least(a, b) <= NEAR and (made := script(a, b, NEAR)) is not None:
        return [(action, c, head + i) for action, c, i in made]
    if len(b) == 1:  # a has no b, or keeps one and loses the rest
        keep = a.find(b)
        return [(2, 0, head + i) if i else (0, b[0], head) for i in range(len(a) - 1, -1, -1)] if keep < 0 else [(2, 0, head + i) for i in range(len(a) - 1, -1, -1) if i != keep]
    half = len(b) // 2
    cut = int(np.argmin(_column(a, b[:half]) + _column(a[::-1], b[half:][::-1])[::-1]))
    return [(action, c, head + cut + i) for action, c, i in halved(a[cut:], b[half:])] + [(action, c, head + i) for action, c, i in halved(a[:cut], b[:half])]


def encode(parent: bytes, target: bytes) -> bytes | None:
    """None if the lengths differ by over GAP, or if the script, of 4 bytes an edit, and 4 bytes more
    would be longer than the target."""
    if abs(len(parent) - len(target)) > GAP:
        return None
    head, tail = trimmed(parent, target)
    a, b = parent[head : len(parent) - tail], target[head : len(target) - tail]
    most = (len(target) - 4) // 4
    if most < 0 or head + len(a) >= PLACES or (least := _least(a, b)) > most:
        return None
    made = script(a, b, min(NEAR, most)) if least <= NEAR else None
    if made is None and most > NEAR and distance(a, b) <= most:
        made = halved(a, b)
    if made is None:
        return None
    return b"".join((action << 30 | byte << 22 | head + at).to_bytes(4, "big") for action, byte, at in made)


def decode(parent: bytes, delta: bytes) -> bytes:
    """Raises ValueError on a malformed script."""
    if len(delta) % 4:
        raise ValueError("a script has words of four bytes")
    out, end = [], len(parent)
    for i in range(0, len(delta), 4):
        word = int.from_bytes(delta[i : i + 4], "big")
        action, byte, at = word >> 30, word >> 22 & 255, word & PLACES - 1
        over = 0 if action == 1 else 1
        if action == 3 or at + over > end:
            raise ValueError("malformed edit")
        out += [parent[at + over : end][::-1], b"" if action == 2 else bytes([byte])]
        end = at
    return b"".join([*out, parent[:end][::-1]])[::-1]
