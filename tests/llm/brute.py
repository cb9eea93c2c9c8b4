"""Slow, direct versions of the corpus operators to hold them against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {c: c + 32 for c in range(65, 91)}
_TOKENIZER = []


def words(text):
    return WORD.findall(text or "")


def ids(text):
    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return _TOKENIZER[0].encode(text or "", add_special_tokens=False).ids + [2]


def crc(tokens):
    return zlib.crc32(b"".join(t.to_bytes(4, "little") for t in tokens))


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if seen[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def fingerprint(text):
    w = words((text or "").translate(ASCII))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """prints: (doc_id, fingerprint) -> smallest linked id of each."""
    first = defaultdict(list)
    for doc, fp in prints:
        first[fp].append(doc)
    todo, out = set(first), {}
    while todo:
        queue = [todo.pop()]
        group = []
        while queue:
            x = queue.pop()
            group.append(x)
            near = [y for y in todo if (x ^ y).bit_count() <= 4]
            todo -= set(near)
            queue += near
        docs = [d for fp in group for d in first[fp]]
        least = min((d for d in docs if d is not None), default=None)
        out |= {fp: least for fp in group}
    return out


def lines(docs):
    """docs: (doc_id, text) -> (n_lines, n_dropped, kept text) of each, in order."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate(ASCII)
    least, docs = {}, list(docs)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if len(k := key(x)) >= 10 and doc is not None:
                least[k] = min(least.get(k, doc), doc)
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        keep = [x for x in own if len(key(x)) < 10 or key(x) not in least or doc is not None and least[key(x)] == doc]
        out.append((len(own), len(own) - len(keep), "\n".join(keep)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def targets(sizes, weights=(5, 2, 1), budget=1.5, repeats=2):
    """sizes: source -> size. Reshares until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, got = budget * sum(sizes.values()), set(sizes), {}
    while True:
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return got | share
        for s in over:
            got[s] = repeats * sizes[s]
            left -= got[s]
            free.remove(s)
        if not free:
            return got


def mixed(docs, weights=(5, 2, 1), budget=1.5, repeats=2, seed=11):
    """docs: (doc_id, size, source) -> (doc_id, size, source_size, target, taken): each source's words
    queue up one by one; all words are served by virtual finish time until the budget is spent."""
    sizes = Counter()
    for _, n, s in docs:
        sizes[s] += n
    aims = targets(sizes, weights, budget, repeats)
    place = lambda d: 0 if d is None else int(hashlib.md5(f"{seed}|{d}".encode()).hexdigest()[:15], 16)
    order = sorted(range(len(docs)), key=lambda i: (place(docs[i][0]), docs[i][0] is not None, docs[i][0] or 0, docs[i][1]))
    served, upto = [], Counter()
    for turn in range(repeats):
        for i in order:
            d, n, s = docs[i]
            whole = upto[s] + n <= aims[s]
            if n and upto[s] <= aims[s]:
                for j in [n] if whole else range(1, n + 1):
                    served.append(((upto[s] + j) / aims[s], place(d), (d is not None, d or 0), turn, n, n if whole else 1, i))
            upto[s] += n
    left, taken = int(budget * sum(sizes.values())), Counter()
    for *_, words_, i in sorted(served):
        taken[i] += max(0, min(words_, left))
        left -= words_
    return [(d, n, sizes[s], aims[s], taken[i]) for i, (d, n, s) in enumerate(docs)]


#: An independent reading of what the tables plant and the odd rows hold.
_ENTITY = re.compile(
    r"(?P<email>[a-z]+\.[0-9]+@[a-z0-9]+(?:\.[a-z0-9]+)+)|(?P<secret>(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z]))|(?P<card>(?<![0-9A-Za-z.-])[0-9]{16}(?![0-9A-Za-z-]))"
    r"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]))|(?P<phone>\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})"
)


def entities(text):
    return [(m.start(), m.end(), m.lastgroup, m[0]) for m in _ENTITY.finditer(text)]


def around(text, found):
    """The text before each entity (from the one before) and after it."""
    ends = [0] + [b for _, b, *_ in found]
    starts = [a for a, *_ in found] + [len(text)]
    return [(text[ends[i] : starts[i]], text[ends[i + 1] : starts[i + 1]]) for i in range(len(found))]


def form(kind, value):
    """What a surrogate has in common with its entity."""
    if kind == "ip":
        return value.count("."), all(0 <= int(x) < 256 for x in value.split("."))
    return re.sub(r"[0-9a-f]", "x", value) if kind == "secret" else re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", value))


def name_of(kind, value):
    return re.sub(r"[^0-9]", "", value)[-10:] if kind == "phone" else value


def chunk_ends(raw):
    """Ends of the content-defined chunks of bytes, one byte after the other."""
    gear_of = [xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)]
    white, out = b" \t\n\v\f\r", []
    for i in range(15, len(raw)):
        h = 0
        for b in raw[i - 15 : i + 1]:
            h = (2 * h + gear_of[b]) % 2**32
        first = i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80
        long_ = i >= 39 and not any(b in white for b in raw[i - 39 : i + 1])
        if raw[i] in white and 4 * h < 2**32 or first and h < int(2**32 / (12 if long_ else 512)):
            out.append(i + 1)
    return out if not raw or out and out[-1] == len(raw) else [*out, len(raw)]


def ratio_scores(docs, trusted, buckets=8192, reject=0.005, step=10_000):
    """docs: (doc_id, text), trusted: ids -> (score of each, threshold): log ratio of hashed unigrams
    and bigrams, those of a trusted half counted for the other half and for all others of its kind."""
    import math

    h64 = lambda x, seed=42: xxhash.xxh64_intdigest(x, seed)
    long_ = lambda x: (x % 2**64).to_bytes(8, "little")
    pmod = lambda x, n: (x - 2**64 if x >= 2**63 else x) % n

    def grams(text):
        one = [h64(w.encode()) for w in words(text)]
        two = [h64(long_(b), h64(long_(a))) for a, b in zip(one, one[1:])]
        return [pmod(x, buckets) for x in one] + [buckets + pmod(x, buckets) for x in two]

    half = lambda d: 42 % 2 if d is None else pmod(h64(long_(d)), 2)  # noqa: E731  the hash of a null is its seed
    raw, target, made = [0] * (2 * buckets), [[0] * (2 * buckets), [0] * (2 * buckets)], [grams(t) for _, t in docs]
    for (d, _), g in zip(docs, made):
        for b in g:
            raw[b] += 1
            if d in trusted and d is not None:
                target[1 - half(d)][b] += 1
    weights = [[0.0] * (2 * buckets) for _ in range(2)]
    for o in range(2):
        span = range(o * buckets, (o + 1) * buckets)
        whole = sum(raw[b] + 1 for b in span)
        for k in range(2):
            seen = sum(target[k][b] for b in span)
            for b in span:
                share = (raw[b] + 1) / whole
                weights[k][b] = round(math.log((target[k][b] + buckets * share) / (seen + buckets) / share), 6)
    scores = [sum(weights[half(d)][b] for b in g) / len(g) if g else None for (d, _), g in zip(docs, made)]
    own = sorted(math.floor(s * step) for (d, t), s in zip(docs, scores) if d in trusted and d is not None and not quality(t)[-1])
    least = next((x / step for i, x in enumerate(own) if sum(y <= x for y in own) > reject * len(own)), None)
    return scores, least


def shards(docs, n, tolerance=0.001):
    """docs: (doc_id, text) -> shard of each: bytes below every candidate boundary are summed over all
    documents; boundaries are refined by prefixes of the key (hash of the text, hash of the id)."""
    own = []
    for d, t in docs:
        raw = (t or "").encode()
        own.append((xxhash.xxh64_intdigest(raw, 42) << 64 | (42 if d is None else xxhash.xxh64_intdigest((d % 2**64).to_bytes(8, "little"), 42)), len(raw) + 8))
    total, found, open_, bits, step = sum(w for _, w in own), {}, {0: list(range(1, n))}, 0, 12
    below = lambda p, b: sum(w for k, w in own if k >> (128 - b) < p)
    while open_ and total:
        at, nxt, one_text = bits + step, {}, {}
        for p, wanted in open_.items():
            for j in wanted:
                parts = sorted({k >> (128 - at) for k, _ in own if k >> (128 - bits) == p})
                q = next((q for q in parts if below(q + 1, at) >= total * j / n), parts[-1])
                inside = {k for k, _ in own if k >> (128 - at) == q}
                rows_ = sum(k >> (128 - at) == q for k, _ in own)
                low, high = total * j / n - below(q, at), below(q + 1, at) - total * j / n
                if rows_ == 1 or at >= 128 or len(inside) == 1 or min(low, high) <= tolerance * total / n:
                    found[j] = (q if low <= high else q + 1) << (128 - at)
                else:
                    nxt.setdefault(q, []).append(j)
                    if at < 64 and len({k >> 64 for k in inside}) == 1:
                        one_text[q] = next(iter(inside)) >> 64
        bits, step = at, min(8, 128 - at)
        if nxt and len(one_text) == len(nxt):
            nxt, bits, step = {one_text[q]: js for q, js in nxt.items()}, 64, 8
        elif nxt and bits < 64 < bits + step:
            step = 64 - bits
        open_ = nxt
    cuts = [min(found.get(j, 0), 2**128 - 1) for j in range(1, n)]
    return [sum(c <= k for c in cuts) for k, _ in own]
