"""Token ids of whole texts by the tokenizers library, with a bounded memory of what it gave for the units of earlier texts.

A unit is a stretch of text at whose ends a tokenizer's own splitting always cuts, so that the ids of a text are the ids of its
units in a row. Two kinds of tokenizer are known:

* ``byte_level``: the byte-level pattern, where a word takes one space before it and other white space stands for itself;
* ``words``: white space is dropped and only separates words.

Units end at ASCII white space, and between a run of Latin letters and a run of ASCII signs (without the apostrophe, which starts
contractions). A text with any other character that some library counts as white space is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

_WHITE = r" \t\n\r\x0b\x0c"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGN = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
_WORD = rf"[{_LETTER}]+(?![^{_WHITE}{_SIGN}])|[{_SIGN}]+(?![^{_WHITE}{_LETTER}0-9])"
UNITS = {
    "byte_level": re.compile(rf"[ ]?(?:{_WORD}|[^{_WHITE}]+)|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"),
    "words": re.compile(rf"{_WORD}|[^{_WHITE}]+"),
}
#: Separators that ``str.isspace`` or a Unicode-aware pattern may take for white space, beyond the ASCII ones.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


def is_plain(text: str) -> bool:
    """Whether all white space in ``text`` is ASCII white space, by any library's measure."""
    return _ODD.search(text) is None


class Memory(dict):
    """What ``make`` gives per key. The keys in use lately stay; at most twice ``bound`` are held, none over ``longest`` characters."""

    def __init__(self, make: Callable[[str], object], bound: int = 250_000, longest: int = 64) -> None:
        self.make, self.bound, self.longest, self.old = make, bound, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """One printable character per byte: itself where it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class UnitEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers in bytes.

    A unit of Latin letters is one pre-token: it goes straight to the tokenizer's model, each letter as the tokenizer's normaliser
    and byte alphabet write it. All other units go through the tokenizer.
    """

    def __init__(self, file: str, units: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.units, self.known = UNITS[units], Memory(self.fresh)
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        alphabet = byte_alphabet()
        written = {ord(c): "".join(alphabet[b] for b in normal(c).encode()) for c in map(chr, range(256)) if re.fullmatch(f"[{_LETTER}]", c)}
        self.written = written | {ord(" "): alphabet[ord(" ")]}
        self.size = self.tokenizer.get_vocab_size()
        self.letters = re.compile(f"[ ]?[{_LETTER}]+").fullmatch

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def fresh(self, unit: str) -> bytes:
        if self.letters(unit):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(unit.translate(self.written))]).tobytes()
        return self.whole(unit)

    def encode(self, text: str) -> bytes:
        if is_plain(text):
            return b"".join(map(self.known.__getitem__, self.units.findall(text)))
        return self.whole(text)


_ENCODERS: dict[tuple[str, str], UnitEncoder] = {}


def encoder(file: str, units: str) -> UnitEncoder:
    """One encoder per worker and file."""
    if (file, units) not in _ENCODERS:
        _ENCODERS[file, units] = UnitEncoder(file, units)
    return _ENCODERS[file, units]
