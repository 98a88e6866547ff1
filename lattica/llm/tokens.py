"""Public tokenizers over whole texts, with a cache of the fragments between blanks.

Both tokenizers cut a text into pre-tokens before they merge anything, and never across certain
places: the word tokenizer drops white space, so blanks and line ends part its input; the byte
tokenizer starts a new pre-token at a blank between two other characters, and a line end between
two is a pre-token of its own.  Cut at such places only, the fragments' ids laid end to end are the ids of the
whole text, and most fragments have been seen before.  A new fragment of letters only is one
pre-token, so it goes straight to the tokenizer's model; any other goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fragments that a generation holds; the one before it is kept for those that come again.
CACHED = 350_000
_ADJACENT = re.compile(r"\s\s")
#: Marks that end a word; after letters, a run of them is a pre-token.  The apostrophe may begin another kind.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_ASCII_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_BLANKS = _ASCII_BLANKS + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _visible_bytes() -> dict[int, str]:
    """The characters by which byte-level models name bytes: printable Latin-1 ones stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + others.index(b)) for b in others}


def _plain_blanks(text: str) -> bool:
    """Only single blanks and line ends part the text's words."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (_ASCII_BLANKS if text.isascii() else _BLANKS))


class _Learned(dict):
    """Ids by fragment; a new one is taken over from the generation before, or learned, when it is looked up."""

    def __init__(self, learn):
        self.learn, self.before = learn, {}

    def __missing__(self, fragment: str) -> bytes:
        found = self.before.get(fragment)
        if found is None:
            found = self.learn(fragment)
        self[fragment] = found
        return found

    def age(self) -> None:
        if len(self) > CACHED:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Special tokens' strings in a text are ordinary text, so that no document can end itself, or with
    ``special`` they are those tokens, as in a plain call of the library.
    """

    def __init__(self, path: str, words: bool, special: bool = False):
        self.words = words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model = self.tokenizer.model
        self.names = _visible_bytes()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known = _Learned(self._learn_word if words else self._learn)
        self.after_blank = _Learned(self._learn_after_blank)

    def _whole(self, fragment: str) -> bytes:
        return array("I", self.tokenizer.encode(fragment, add_special_tokens=False).ids).tobytes()

    def _letters(self, name: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(name)])

    def _learn_word(self, fragment: str) -> bytes:
        """Ids of a fragment for the word tokenizer; letters before marks are looked up by themselves."""
        if fragment.isalpha():
            lower = fragment.lower() if fragment.isascii() else self.tokenizer.normalizer.normalize_str(fragment)
            if lower != fragment:
                return self.known[lower] if lower else b""
            return self._letters(fragment if fragment.isascii() else fragment.encode().decode("latin-1").translate(self.names))
        head = fragment.rstrip(_MARKS)
        # Some letters' normal forms end in a combining mark, which belongs to the marks after it.
        if head.isalpha() and (head.isascii() or self.tokenizer.normalizer.normalize_str(head).isalpha()):
            return self.known[head] + self.known[fragment[len(head) :]]
        return self._whole(fragment) if fragment else b""

    def _learn(self, fragment: str) -> bytes:
        """Ids of a fragment for the byte tokenizer."""
        return self._whole(fragment) if fragment else b""

    def _learn_after_blank(self, fragment: str) -> bytes:
        """The same with a blank before it."""
        if fragment.isalpha():
            return self._letters(self.names[0x20] + (fragment if fragment.isascii() else fragment.encode().decode("latin-1").translate(self.names)))
        head = fragment.rstrip(_MARKS)
        if head.isalpha():
            return self.after_blank[head] + self.known[fragment[len(head) :]]
        return self._whole(" " + fragment)

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special and any(s in text for s in self.special):
            return self._whole(text)
        if self.words:
            return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))
        if not _plain_blanks(text):
            return b"".join(map(self.known.__getitem__, [text] if text.isspace() else _SAFE.split(text)))
        out, end = [], self.known["\n"]
        for line in text.split("\n"):
            first, *others = line.split(" ")
            out += (self.known[first], b"".join(map(self.after_blank.__getitem__, others)), end)
        return b"".join(out[:-1])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            self.known.age()
            self.after_blank.age()
            out.append(self._one(text))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, words: bool, special: bool = False) -> Encoder:
    """The worker's encoder, with what earlier tasks have learned."""
    return Encoder(path, words, special)


def stretches(texts: list, limit: int = 1 << 20):
    """(first, last) of runs of texts of at most about ``limit`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
