"""Words of a batch of texts as 64-bit hashes, by array operations over the texts' bytes.

A word is a stretch without space, tab to carriage return; A-Z count as a-z. Its hash is a polynomial over its bytes modulo 2**64,
mixed; the hash of a run of words mixes theirs in order. Equal words have equal hashes; unequal ones differ but for a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: Bytes that are hashed at once; the powers of the base are kept for so many places.
CHUNK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(CHUNK + 1, base, np.uint64)
            powers[0] = 1
            _POWERS.append(np.multiply.accumulate(powers))
    return _POWERS[0], _POWERS[1]


def word_hashes(text: bytes, blank: np.ndarray = _BLANK) -> np.ndarray:
    """Hashes of the words of one text, in order. A text of any length is taken in pieces that end between words where they can.

    ``blank`` tells of every byte, A-Z taken as a-z, whether it stands between words.
    """
    if len(text) > CHUNK:
        data, parts, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(text):
            stop = min(len(text), at + CHUNK)
            if stop < len(text):
                gaps = np.flatnonzero(blank[_FOLD[data[at:stop]]])
                stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
                if not len(gaps):  # one word of more than a piece: its end decides
                    later = np.flatnonzero(blank[_FOLD[data[stop:]]])
                    stop = stop + int(later[0]) if len(later) else len(text)
            parts.append(_one_word(text[at:stop]) if stop - at > CHUNK else word_hashes(text[at:stop], blank))
            at = stop
        return np.concatenate(parts)
    data = _FOLD[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~blank[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def _one_word(text: bytes) -> np.ndarray:
    """The hash of a text that is one word of more than ``CHUNK`` bytes."""
    total, power = 0, 1
    data = _FOLD[np.frombuffer(text, np.uint8)]
    up, _ = _powers()
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
        total = (total + int((part * up[: len(part)]).sum(dtype=np.uint64)) * power) & _MASK
        power = power * pow(_BASE, len(part), 1 << 64) & _MASK
    return mix(np.array([(total + len(data) * _ODD) & _MASK], np.uint64))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; with fewer words, of all of them together; without words none."""
    words = word_hashes(text)
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(_ODD) + words[i : i + n])
    return np.unique(out)
