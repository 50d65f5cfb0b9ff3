"""Pre-tokens of a word-end BPE vocabulary, and the ids of each from the tokenizers library, kept by word.

A text whose characters are all plain Latin ones is split here by the vocabulary's own pattern, which gives what the
library gives; any other text, and one with a special token in it, goes through the library's own steps whole. The kept
words of a Python worker are dropped when they hold `MOST_BYTES`, and at the end of a task, so memory stays bounded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import Counter
from functools import lru_cache

MOST_BYTES = 48 << 20
#: What a kept word takes besides its characters and its value's.
ENTRY_BYTES = 240
LONGEST_KEPT = 48
HOT_WORDS = 8_192
#: Latin characters whose NFC form is themselves and whose lower case is one character.
PLAIN = re.compile("[\t\n\r -~ -įı-ɏ]*")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in [*range(0x20, 0x7F), *range(0xA0, 0x250)] if unicodedata.category(chr(c))[0] == kind)


SPLIT = re.compile(f"[{_class('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def definition(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def specials(path: str) -> re.Pattern:
    return re.compile("|".join(re.escape(x["content"]) for x in sorted(definition(path)["added_tokens"], key=lambda x: -len(x["content"]))) or r"(?!)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def plain_words(text: str, path: str) -> list[str] | None:
    """The text's pre-tokens, or None where only the library can tell."""
    if not PLAIN.fullmatch(text) or ("<|" in text and specials(path).search(text)):
        return None
    return SPLIT.findall(text.lower())


class _Hot(dict):
    """The commonest words of the first pass, which stay in a processor's cache; it asks `rest` for others."""

    def __init__(self):
        super().__init__()
        self.rest: dict = {}

    def __missing__(self, word: str):
        return self.rest.get(word)


class Kept:
    """Values of words, learned in batches and kept within the bounds above."""

    def __init__(self, learn, most: int = MOST_BYTES):
        self.learn, self.most, self.hot, self.held = learn, most, _Hot(), 0

    def clear(self) -> None:
        self.hot, self.held = _Hot(), 0

    @staticmethod
    def size_of(value) -> int:
        return len(value) if isinstance(value, bytes) else sum(len(v) if isinstance(v, str) else 8 for v in value) + 150

    def values(self, lists: list[list[str]]) -> list[list]:
        get = self.hot.__getitem__
        found = [list(map(get, words)) for words in lists]
        lacking = [i for i, x in enumerate(found) if None in x]
        new = list({w for i in lacking for w, x in zip(lists[i], found[i], strict=True) if x is None})
        if new:
            learned = dict(zip(new, self.learn(new), strict=True))
            for i in lacking:
                found[i] = [learned[w] if x is None else x for w, x in zip(lists[i], found[i], strict=True)]
            if self.held > self.most:
                self.hot.rest.clear()
                self.held = 0
            if not self.hot:
                common = Counter(w for words in lists for w in words).most_common(HOT_WORDS)
                self.hot.update((w, learned[w]) for w, _ in common if len(w) <= LONGEST_KEPT)
            for w, x in learned.items():
                if len(w) <= LONGEST_KEPT:
                    self.hot.rest[w] = x
                    self.held += ENTRY_BYTES + len(w) + self.size_of(x)
        return found


class LibraryIds:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, tokenizer(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.kept = Kept(lambda words: list(map(self._ids, words)))

    def _ids(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [plain_words(x, self.path) for x in texts]
        plain = iter(self.kept.values([x for x in split if x is not None]))
        return [array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() if words is None else b"".join(next(plain)) for x, words in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    """One for each Python worker."""
    return LibraryIds(path)
