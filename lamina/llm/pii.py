"""PII surrogates: keyed, type-consistent replacements of personal data and secrets.

What is found: e-mail addresses; telephone numbers (3-3-4 digits with separators, or + and 8 to 15
digits); payment cards (16 digits, or 13 to 19 with a right check digit); IBANs with right check
digits; IPv4 and IPv6 addresses; numbers of the form 000-00-0000; secrets (32 or more hex digits of one
case, well-known key forms, quoted values of passwords, tokens and keys); names after a title, after a
phrase that introduces one, or that begin with a given name of the lexicon, and further mentions of
their surnames in the same text. Other forms are not found.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

KEY = "lamina"
#: Entities whose first surrogate clashed travel to the workers up to this many, else by a join.
MOVED = 50_000
#: From this salt on, surrogates without a fixed length get a letter more for each further salt.
WIDEN = 8
#: Salts that an entity of a fixed length may need; a format with no value left raises.
SALTS = 64

GIVEN = {
    ("f", "latin"): "anna maria emma laura julia sarah elena claire sophie carmen lucia ingrid hannah alice nadia marie katrin isabel paula teresa helen susan linda karen".split(),
    ("m", "latin"): "john james peter paul thomas martin lukas david daniel carlos miguel pierre jean hans klaus stefan robert michael andrew pablo diego louis henri erik".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья ирина светлана татьяна".split(),
    ("m", "cyrillic"): "иван пётр сергей алексей дмитрий андрей михаил николай".split(),
    ("f", "greek"): "μαρία ελένη κατερίνα σοφία".split(),
    ("m", "greek"): "γιώργος νίκος δημήτρης κώστας".split(),
}
_TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame".split())
_CUES = ("my name is ", "My name is ", "je m'appelle ", "Je m'appelle ", "ich heiße ", "Ich heiße ", "me llamo ", "Me llamo ", "меня зовут ", "με λένε ", "Name: ")
_KEYS = re.compile(
    r"(?<![0-9A-Za-z])(?:(?P<head>A[KS]IA)[0-9A-Z]{16}|(?P<head2>gh[pousr]_)[0-9A-Za-z]{36,255}|(?P<head3>sk-)[0-9A-Za-z_-]{20,255}"
    r"|(?P<head4>xox[abprs]-)[0-9A-Za-z-]{10,255}|(?P<head5>eyJ)[0-9A-Za-z_-]{10,4096}\.[0-9A-Za-z_-]{10,4096}\.[0-9A-Za-z_-]{10,4096})(?![0-9A-Za-z])"
)
_KEY_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ")
_QUOTED = re.compile(r"(?i:passw(?:or)?d|secret|token|api[_-]?key)[\"']?[ \t]{0,8}[=:][ \t]{0,8}[\"']([^\s\"']{8,256})[\"']")
_HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_CARD = re.compile(r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IP4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:.])")
_PHONE = re.compile(r"(?<![\w+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9](?:[ .()/-]{0,2}[0-9]){7,14})(?!\w)")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_CAP = "A-ZÀ-ÖØ-ÞĀ-ŽΆ-ΏΑ-ΫЀ-Я"
#: A capitalised word, one space, the start of another; the words' lengths are bounded.
_PAIR = re.compile(rf"[{_CAP}][^\W\d_]{{1,40}}\.? (?=[{_CAP}])")
_SURNAME = re.compile(rf"[{_CAP}](?:[^\W\d_]|['’-](?=[^\W\d_])){{1,40}}(?![^\W\d_])")
_DIGITS = re.compile(r"[0-9]")


class Lexicon:
    """Given names by (gender, script), lower case: what names begin with, and what replaces them."""

    def __init__(self, groups: dict = GIVEN):
        self.groups = groups
        self.group = {n: g for g, names in groups.items() for n in names}

    @lru_cache(64)
    def turned(self, group, key: str) -> dict:
        """A keyed cycle through a group's names: each name's replacement, never itself if there are two."""
        order = sorted(self.groups[group], key=lambda n: hashlib.blake2b(n.encode(), digest_size=16, key=key.encode()[:64]).digest())
        return dict(zip(order, order[1:] + order[:1]))


LEXICON = Lexicon()


def low(text: str) -> str:
    """text in lower case, a character for each."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> int:
    """0 if the last digit is right, else what it is off by."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


# -- what is found -------------------------------------------------------------------------------


def _emails(t: str):
    at = t.find("@")
    while at >= 0:
        a = at
        while a > max(0, at - 64) and (t[a - 1].isalnum() or t[a - 1] in "._%+-"):
            a -= 1
        while a < at and not t[a].isalnum():
            a += 1
        if a < at and t[at - 1] != "." and (m := _DOMAIN.match(t, at + 1, at + 254)):
            yield a, m.end(), "email"
        at = t.find("@", at + 1)


def _numbers(t: str):
    for m in _HEX_RUN.finditer(t):
        if _DIGITS.search(m[0]) and not m[0].isdigit():
            yield *m.span(), "secret"
    for m in _CARD.finditer(t):
        digits = re.sub(r"\D", "", m[0])
        if 13 <= len(digits) <= 19 and (len(digits) == 16 or luhn(digits) == 0):
            yield *m.span(), "card"
    for m in _SSN.finditer(t):
        yield *m.span(), "ssn"
    if t.count(".") > 2:
        for m in _IP4.finditer(t):
            yield *m.span(), "ip"
    for m in _PHONE.finditer(t):
        yield *m.span(), "phone"
    if t.count(":") > 1:
        for m in _IP6.finditer(t):
            if sum(map(bool, m[0].split(":"))) > 2:
                try:
                    ipaddress.IPv6Address(m[0])
                except ValueError:
                    continue
                yield *m.span(), "ip6"
    for m in _IBAN.finditer(t):
        if _iban_rest(m[0].replace(" ", "")) == 1:
            yield *m.span(), "iban"


def _secrets(t: str):
    if any(k in t for k in _KEY_MARKS):
        for m in _KEYS.finditer(t):
            yield *m.span(), "secret"
    if '"' in t or "'" in t:
        for m in _QUOTED.finditer(t):
            yield *m.span(1), "secret"


def _names(t: str, lexicon: Lexicon):
    """Words of names: given names of the lexicon as `given`, all others as `name`."""
    starts = []
    for m in _PAIR.finditer(t):
        word, a = m[0][:-1], m.start()
        if a and (t[a - 1].isalpha() or t[a - 1] in "'’-"):
            continue
        if word.rstrip(".") in _TITLES:
            starts.append(m.end())
        elif word[-1] != "." and low(word) in lexicon.group:
            starts.append(a)
    for cue in _CUES:
        at = t.find(cue)
        while at >= 0:
            starts.append(at + len(cue))
            at = t.find(cue, at + 1)
    found, last = {}, -1
    for a in sorted(set(starts)):
        if a < last:
            continue
        words = []
        while len(words) < 3 and (m := _SURNAME.match(t, a)) and m[0] not in _TITLES:
            words.append(m)
            a = last = m.end() + 1
            if t[m.end() : a] != " " or len(words) == 2 and low(words[0][0]) not in lexicon.group:
                break
        if len(words) == 3 and low(words[1][0]) not in lexicon.group:
            words.pop()
        for k, m in enumerate(words):
            kind = "given" if k < len(words) - 1 and low(m[0]) in lexicon.group else "name"
            yield *m.span(), kind
            if kind == "name" and len(m[0]) > 3:
                found[m[0]] = None
    if found:  # further mentions of the surnames
        again = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + r")(?![^\W\d_])")
        for m in again.finditer(t):
            yield *m.span(), "name"


_ORDER = ("email", "secret", "iban", "card", "ssn", "ip", "ip6", "phone", "given", "name")


def entities(text: str, lexicon: Lexicon = LEXICON) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in order, without overlaps: of those that do, the one that starts
    first, then by kind. Linear in the text but for bounded windows."""
    found = {}
    if "@" in text:
        found |= dict.fromkeys(_emails(text))
    if _DIGITS.search(text):
        found |= dict.fromkeys(_numbers(text))
    found |= dict.fromkeys(_secrets(text))
    found |= dict.fromkeys(_names(text, lexicon))
    out, at = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], _ORDER.index(x[2]), -x[1])):
        if a >= at:
            out.append((a, b, kind, text[a:b]))
            at = b
    return out


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ip6":
        return ipaddress.IPv6Address(value).compressed
    return value if kind == "secret" else low(value)


# -- surrogates ----------------------------------------------------------------------------------

_LETTERS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ")
_PLACE = {c: (a, i) for a in _LETTERS for i, c in enumerate(a)}
_HEX = "0123456789abcdef"
_BASE62 = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(4096)
def _symbol(c: str) -> tuple[str, int] | None:
    """The alphabet of a lower-case character and its place there. Beyond the lists: the letters of the
    same kind among 64 neighbours in Unicode, so accented letters stay accented; None if not a letter."""
    if c in _PLACE:
        return _PLACE[c]
    if not c.isalpha():
        return None
    kind, first = unicodedata.category(c), ord(c) // 64 * 64
    own = "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and low(x) == x and x not in _PLACE)
    return own, own.index(c)


def _shift(key: str, tweak: str, value: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{value}".encode(), digest_size=16, key=key.encode()[:64]).digest(), "big") % size


def permuted(values: list[int], sizes: list[int], key: str, tweak: str) -> list[int]:
    """A keyed permutation of the strings of these symbol sizes: a Feistel network on two halves."""
    half = len(values) // 2

    def number(lo, hi):
        n = 0
        for v, s in zip(values[lo:hi], sizes[lo:hi]):
            n = n * s + v
        return n

    def product(lo, hi):
        n = 1
        for s in sizes[lo:hi]:
            n *= s
        return n

    a, b, na, nb = number(0, half), number(half, len(values)), product(0, half), product(half, len(values))
    for r in range(4):
        a = (a + _shift(key, f"{tweak}a{r}", b, na)) % na
        b = (b + _shift(key, f"{tweak}b{r}", a, nb)) % nb
    out = []
    for n, part in ((b, sizes[half:]), (a, sizes[:half])):
        got = []
        for s in reversed(part):
            n, v = divmod(n, s)
            got.append(v)
        out = got[::-1] + out
    return out


def written(text: str, symbols: list, key: str, tweak: str) -> str:
    """text with each character of an alphabet (symbols: (alphabet, place) or None, one a character)
    permuted in it; the others stay where they are."""
    at = [(i, *s) for i, s in enumerate(symbols) if s]
    if not at:
        return text
    made = permuted([v for _, _, v in at], [len(a) for _, a, _ in at], key, f"{tweak}|{''.join(a[0] for _, a, _ in at)}")
    out = list(text)
    for (i, a, _), v in zip(at, made):
        out[i] = a[v]
    return "".join(out)


def spelled(text: str, key: str, tweak: str) -> str:
    """A lower-case text with digits for digits, vowels of a script for vowels, and so on."""
    return written(text, [_symbol(c) for c in text], key, tweak)


def _digits(text: str, key: str, tweak: str) -> str:
    return written(text, [("0123456789", int(c)) for c in text], key, tweak)


def _cased(made: str, like: str) -> str:
    """made with capitals where `like` has them; what is longer is as the end of `like`."""
    up = [c != c.lower() for c in like]
    up += [bool(up) and len(up) > 1 and up[-1]] * (len(made) - len(up))
    return "".join(x if u and len(x := c.upper()) == 1 and x.lower() == c else c for c, u in zip(made, up))


def _refilled(value: str, made: str) -> str:
    """value with its digits and letters replaced in turn by those of `made`."""
    own = iter(made)
    return "".join(next(own) if c.isalnum() else c for c in value)


def _private(ip: tuple) -> bool:
    return ip[0] in (0, 10, 127) or ip[0] >= 224 or ip[:2] in ((192, 168), (169, 254)) or (ip[0] == 172 and 16 <= ip[1] < 32)


def _walk(step, start, allowed):
    """Cycle walking keeps a permutation within the allowed values, where `start` lies."""
    x = step(start)
    while not allowed(x):
        x = step(x)
    return x


@lru_cache(1 << 16)
def replacement(kind: str, name: str, key: str = KEY, salt: int = 0) -> str:
    """The canonical form of the surrogate of the entity with this canonical name: equal for equal
    entities, different for different ones of a kind (every step permutes within the format)."""
    tweak = f"{kind}{salt}"
    wide = "".join("bdfgklmnprst"[_shift(key, f"{tweak}w{i}{name}", 0, 12)] for i in range(max(0, salt - WIDEN + 1)))
    if kind == "name":
        return spelled(name, key, tweak) + wide
    if kind == "secret":
        head = next((x for x in m.groups() if x), "") if (m := _KEYS.fullmatch(name)) else ""
        rest = name[len(head) :]
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", rest):
            alphabets = (_HEX.upper() if any(c in "ABCDEF" for c in rest) else _HEX,)
        else:
            alphabets = _BASE62
        place = lambda c: next(((a, a.index(c)) for a in alphabets if c in a), None) or _symbol(c)
        return head + written(rest, [place(c) for c in rest], key, tweak) + wide
    if kind == "email":
        local, domain = name.split("@")
        host, top = domain.rsplit(".", 1)
        return f"{spelled(local, key, tweak + 'l')}{wide}@{spelled(host, key, tweak + 'd')}.{top}"
    if kind == "ip":
        ip = tuple(map(int, name.split(".")))
        step = lambda x: tuple(permuted(list(x), [256] * 4, key, tweak))
        return ".".join(map(str, _walk(step, ip, lambda x: _private(x) == _private(ip))))
    if kind == "ip6":  # groups of zeros stay
        groups = [int(x, 16) for x in ipaddress.IPv6Address(name).exploded.split(":")]
        at = [i for i, g in enumerate(groups) if g]
        for i, v in zip(at, permuted([groups[i] - 1 for i in at], [65535] * len(at), key, f"{tweak}{at}")):
            groups[i] = v + 1
        return ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups)).compressed
    if kind == "card":  # the issuer's digit stays, and by how much the check digit is off
        front = name[0] + _digits(name[1:-1], key, f"{tweak}{name[0]}{len(name)}")
        return front + str((int(luhn(name)) - luhn(front + "0")) % 10)
    if kind == "iban":
        body = written(name[4:], [next((a, a.index(c)) for a in _BASE62 if c in a) for c in name[4:]], key, tweak + name[:2])
        return f"{name[:2]}{98 - _iban_rest(name[:2] + '00' + body):02d}{body}"
    if kind == "phone" and len(name) == 10:  # area codes and exchanges begin with 2 to 9, or stay out of it
        alphabet = lambda i, c: ("23456789" if c > "1" else "01") if i in (0, 3) else "0123456789"
        return written(name, [(a, a.index(c)) for i, c in enumerate(name) for a in [alphabet(i, c)]], key, tweak)
    if kind == "phone":
        return name[:2] + _digits(name[2:], key, f"{tweak}{name[:2]}{len(name)}")
    return _digits(name, key, tweak)


def surrogate(kind: str, value: str, key: str = KEY, salt: int = 0, lexicon: Lexicon = LEXICON) -> str:
    """What is written instead of `value`: the replacement in value's own case, separators and form."""
    if kind == "given":
        name = low(value)
        return _cased(lexicon.turned(lexicon.group[name], key)[name], value)
    name = canonical(kind, value)
    made = replacement(kind, name, key, salt)
    if kind in ("name", "email"):
        if kind == "email":  # the letters that were added stand before the @
            cut, own = made.index("@"), value.index("@")
            return _cased(made[:cut], value[:own]) + _cased(made[cut:], value[own:])
        return _cased(made, value)
    if kind in ("card", "ssn", "iban"):
        return _refilled(value, made)
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        return _refilled(value, digits[: len(digits) - len(made)] + made)
    if kind == "ip6":
        return ipaddress.IPv6Address(made).exploded if len(value) == 39 else made
    return made


# -- over tables ---------------------------------------------------------------------------------


def _found(key: str, lexicon: Lexicon):
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            own = dict.fromkeys((k, canonical(k, v)) for _, _, k, v in entities(t, lexicon) if k != "given") if t else ()
            out.append([{"kind": k, "name": n, "made": replacement(k, n, key)} for k, n in own])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<kind:string,name:string,made:string>>")


def replaced(text: str, key: str, salts: dict, lexicon: Lexicon = LEXICON) -> tuple[str | None, int]:
    """The text with its surrogates, None if it has no entity, and their number."""
    parts, at, found = [], 0, entities(text, lexicon)
    for a, b, kind, value in found:
        parts += [text[at:a], surrogate(kind, value, key, salts.get((kind, canonical(kind, value)), 0) if salts else 0, lexicon)]
        at = b
    return "".join([*parts, text[at:]]) if found else None, len(found)


def _replaced(key: str, moved: dict | None, lexicon: Lexicon):
    def frame(made) -> pd.DataFrame:
        texts, n = zip(*made) if made else ((), ())
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "n": pd.Series(n, dtype="int64")})

    def alone(texts: pd.Series) -> pd.DataFrame:
        return frame([replaced(t, key, moved, lexicon) if t else (None, 0) for t in texts])

    def each(texts: pd.Series, salts: pd.Series) -> pd.DataFrame:
        own = [{} if s is None else {(x["kind"], x["name"]): x["salt"] for x in s} for s in salts]
        return frame([replaced(t, key, s, lexicon) if t else (None, 0) for t, s in zip(texts, own)])

    return F.pandas_udf(alone if moved is not None else each, "struct<text:string,n:long>")


def clashes(df: DataFrame, key: str = KEY, lexicon: Lexicon = LEXICON) -> DataFrame:
    """kind, name, salt: the entities of df that need another salt than 0.

    Over all different entities of df, a surrogate must neither be an entity of df (itself included)
    nor the surrogate of another; of those that share one the smallest keeps it if it is no entity.
    The rest are salted anew until none clashes. Names, e-mail addresses and secrets get longer from
    the salt WIDEN on, so they always find a value; a format of fixed length that has none left after
    SALTS salts raises, and nothing is returned.
    """
    found = df.select(F.explode(_found(key, lexicon)("text")).alias("e"))
    state = stage(found.select("e.kind", "e.name", "e.made").groupBy("kind", "name").agg(F.min("made").alias("made")).withColumn("salt", F.lit(0)), "entities")

    def anew(kinds: pd.Series, names: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([replacement(a, b, key, c) for a, b, c in zip(kinds, names, salts)], dtype=object)

    again = F.pandas_udf(anew, "string")
    while True:
        first = state.groupBy("kind", "made").agg(F.min("name").alias("first"))
        real = state.select("kind", F.col("name").alias("made"), F.lit(True).alias("real"))
        judged = state.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        judged = stage(judged.withColumn("bad", F.col("real").isNotNull() | (F.col("first") != F.col("name"))), "judged")
        left = judged.filter("bad").agg(F.count(F.lit(1)).alias("n"), F.max("salt").alias("salt"), F.max("kind").alias("kind")).first()
        if not left["n"]:
            return state.filter("salt > 0").select("kind", "name", "salt")
        if left["salt"] >= SALTS:
            raise ValueError(f"no surrogates left for {left['n']} entities, such as of the kind {left['kind']}")
        redone = judged.filter("bad").select("kind", "name", (F.col("salt") + 1).alias("salt")).withColumn("made", again("kind", "name", "salt"))
        state = stage(judged.filter("not bad").select("kind", "name", "made", "salt").unionByName(redone), "entities")


def replace_pii(df: DataFrame, key: str = KEY, moved_bound: int = MOVED, lexicon: Lexicon = LEXICON) -> DataFrame:
    """df with surrogates in `text`, plus n_entities.

    Surrogates are keyed permutations within a format, so workers agree on them without a table;
    only entities that `clashes` re-salts need one: up to `moved_bound` it travels with the
    function, beyond that it is joined to the documents that hold such entities. A surname has one
    surrogate with and without title and given name; given names turn within gender and script.

    Null text stays null with 0 entities; empty text stays. Repeated rows are replaced alike. An
    empty table gives no rows. Other columns pass through; n_entities is replaced.
    """
    df = df.drop("n_entities")
    moved = stage(clashes(df, key, lexicon), "moved")
    text = F.col("text")
    if moved.limit(moved_bound + 1).count() <= moved_bound:
        table = {(r["kind"], r["name"]): r["salt"] for r in moved.collect()}
        made = df.withColumn("__r", _replaced(key, table, lexicon)(text))
    else:
        held = df.select(F.xxhash64("text").alias("__th"), F.explode(_found(key, lexicon)("text")).alias("e"))
        salts = held.select("__th", "e.kind", "e.name").distinct().join(moved, ["kind", "name"]).groupBy("__th").agg(F.collect_list(F.struct("kind", "name", "salt")).alias("__s"))
        made = df.withColumn("__h", F.xxhash64("text")).join(salts, F.col("__h") == F.col("__th"), "left").withColumn("__r", _replaced(key, None, lexicon)(text, F.col("__s"))).drop("__h", "__th", "__s")
    return made.withColumn("text", F.coalesce("__r.text", text)).withColumn("n_entities", F.coalesce("__r.n", F.lit(0)).cast("long")).drop("__r")
