"""Ids of white-space-free words, remembered per task."""

from __future__ import annotations

import gc
import os
import re
from array import array

import pyarrow as pa

#: Words a worker remembers before it starts anew; bounds its memory.
KNOWN_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            letters[chr(spare)] = b
            spare += 1
    return letters


class KnownWords(dict):
    """word (UTF-8 bytes) -> value, made when first asked for."""

    def __init__(self, make, limit: int = KNOWN_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


#: A word, its last letter or digit, and the marks behind it: no token and no
#: normal form reaches over that border.
_WITH_MARKS = re.compile(rb"(.*[A-Za-z0-9])([.,;:!?]+)", re.S)


_kept: list = [None, None]


def kept(key: tuple, make):
    """What ``make`` gives, kept by the worker from task to task until it needs
    something else: one at a time, so that operators don't add up. What the last
    one leaves goes back to the system before the next one is made."""
    if _kept[0] != key:
        _kept[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[:] = [key, make()]
    return _kept[1]


def library_words(path: str, limit: int = KNOWN_WORDS) -> KnownWords:
    """Ids as little-endian unsigned 32-bit integers, by the tokenizer in file
    ``path``. For byte-level vocabularies that lower letters and drop white
    space: the ids of a text are then those of its words, one after the other."""
    return kept(("words", path, limit), lambda: _library_words(path, limit))


def _library_words(path: str, limit: int) -> KnownWords:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    merged = tokenizer.model.tokenize
    letter_of = {b: c for c, b in byte_letters().items()}

    def make(word: bytes) -> bytes:
        if (parts := _WITH_MARKS.fullmatch(word)) and b"<|" not in word:
            return known[parts[1]] + known[parts[2]]
        text = word.decode()
        # Latin letters alone are one word of the vocabulary's own splitting.
        if text.isalpha() and max(text) < "\u0250" and (low := text.lower()).isalpha():
            if low != text:
                return known[low.encode()]
            if not text.isascii():
                text = "".join(map(letter_of.__getitem__, word))
            return array("I", [t.id for t in merged(text)]).tobytes()
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    known = KnownWords(make, limit)
    return known
