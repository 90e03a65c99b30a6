"""Token ids of whole texts by the tokenizers library, word by word with a memory of words already seen.

Both tokenizer files split a text before they merge, and never across a single space or a single line break between
two other characters. So the ids of such a text are the ids of its space-led words and line breaks, one after the
other, and each distinct word needs the library once. A text with any other white space between words (runs, tabs,
at its ends, ...) is given to the library whole where that matters. Letters followed by one stop are split before it,
as the files do; words of Latin-1 letters go to the library's model directly. A test compares both ways.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Words remembered by one Python worker (some 0.2 kB each), which keeps them while it lives unless `coding` ends their use; when
#: full, those not met since it was half full are forgotten. Only speed depends on it.
REMEMBERED = 600_000
#: The letters that stand for bytes without a printable one in both vocabularies.
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate([*range(0, 33), *range(127, 161), 173])}

_coders: dict[str, "Coder"] = {}


def coder(name: str, remembered: int = REMEMBERED) -> "Coder":
    """The coder of a tokenizer file, one per worker process."""
    if name not in _coders:
        _coders[name] = Coder(name)
    _coders[name].remembered = remembered
    return _coders[name]


@contextmanager
def coding(name: str, remembered: int = REMEMBERED) -> Iterator[Callable[[list[str | None]], list[bytes]]]:
    """The `encode` of a tokenizer file for one task. At its end the words are forgotten (the tokenizer stays): a worker lives on,
    idle or with tasks of other steps, and its memory adds to theirs."""
    own = coder(name, remembered)
    try:
        yield own.encode
    finally:
        own.known.forget()


class Known(dict):
    """A dictionary that finds what is missing, first among what it held before it aged."""

    def __init__(self, find: Callable[[str], bytes | None]):
        self.find, self.older = find, {}

    def __missing__(self, word: str) -> bytes | None:
        found = self[word] = self.older[word] if word in self.older else self.find(word)
        return found

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Coder:
    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.byte_level = name.startswith("byte")  # white space counts, and a word differs from a space-led word
        self.lead, self.line_break = (" ", self._whole("\n")) if self.byte_level else ("", b"")
        self.remembered = REMEMBERED
        self.known = Known(self._ids)
        self.stops = {c: self._whole(c) for c in ".,"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str, led: bool) -> bytes:
        """Ids of a word of Latin-1 letters: one unit for the file's model, in the byte alphabet of its vocabulary."""
        unit = word if self.byte_level else word.lower()
        if not word.isascii():
            unit = unit.encode().decode("latin-1").translate(BYTE_LETTERS)
        if self.byte_level and led:
            unit = BYTE_LETTERS[0x20] + unit
        return array("I", [t.id for t in self.tokenizer.model.tokenize(unit)]).tobytes()

    def _ids(self, word: str) -> bytes | None:
        """Ids of a piece between spaces; None if it must not be taken out of its text. A piece that begins with a
        line break stands at a line's start, all others come after a space."""
        body = word[1:] if word[:1] == "\n" else word
        led = body is word or not self.byte_level
        stop = self.stops.get(body[-1:], b"") if body[:-1].isalpha() else b""
        stem = body[:-1] if stop else body
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
            ids = self._letters(stem, led)
        elif self.byte_level and stem.split() != [stem]:
            return None
        else:
            ids = self._whole((self.lead if led else "") + stem)
        return ids + stop if led else self.line_break + ids + stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; a NULL text has none."""
        if 2 * len(self.known) > self.remembered:
            self.known.age()
        skip, known, out = len(self.line_break), self.known.__getitem__, []
        for text in texts:
            words = ("\n" + (text or "")).replace("\n", " \n").split(" ")
            try:
                out.append(b"".join(map(known, words[1:]))[skip:])
            except TypeError:  # a None among them
                out.append(self._whole(text) if text else b"")
        return out
