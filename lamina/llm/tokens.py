"""Token ids of whole texts, word by word where the tokenizer allows it."""

from __future__ import annotations

import json
import re

from .common import Kept

#: Words kept by a worker before it starts afresh; bounds its memory.
CACHED_WORDS = 400_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*.,;:?]*)")


def _byte_level() -> list[str]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
    return [rest.get(b, chr(b)) for b in range(256)]


class _Words(Kept):
    """Word -> its ids as little-endian 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.parts, self.level = tokenizer, {}, _byte_level()

    def clear(self) -> None:
        super().clear()
        self.parts.clear()

    def part(self, run: str) -> bytes:
        """Ids of one run of letters or of punctuation, in lower case."""
        if (got := self.parts.get(run)) is None:
            shown = run if run.isascii() else "".join(self.level[b] for b in run.encode())
            got = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown))
            if len(self.parts) >= CACHED_WORDS:
                self.parts.clear()
            self.parts[run] = got
        return got

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if m := _PLAIN.fullmatch(word):
            got = self.part(m[1].lower()) + (self.part(m[2]) if m[2] else b"")
        else:
            got = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) > 200:
            return got
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = got
        return got


class TextIds:
    """ids(text): all token ids, little-endian unsigned 32-bit.

    A tokenizer that drops white space and never looks past it gives a text the ids of its words in
    turn; those are kept, since most words of a corpus come again. Any other runs over whole texts.
    """

    _made: dict[str, TextIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        wordwise = first.get("pattern") == {"Regex": _PATTERN} and first.get("invert") and first.get("behavior") == "Removed" and steps == ["NFC", "Replace", "Lowercase"]
        self.words = _Words(self.tokenizer) if wordwise else None

    @classmethod
    def at(cls, path: str) -> TextIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        if (words := cls._made[path].words) is not None:
            words.begin()
        return cls._made[path]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words is None:
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
