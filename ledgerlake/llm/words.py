"""Hashes of the words of many texts at once, in numpy.

A word's hash is a polynomial of its characters modulo 2^64: with running sums over all characters of a batch
it is one difference for each word, whatever its length. A finishing step spreads its bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Texts are worked on together until they have so many characters.
CHARACTERS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Fixed value: ASCII white space.
_SPACES = b" \t\n\v\f\r"


@cache
def _word_characters() -> np.ndarray:
    """Whether each code point is part of a word: a letter, a digit or an underscore."""
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), dtype=bool, count=0x110000)


@cache
def _not_space() -> np.ndarray:
    return np.fromiter((i not in _SPACES for i in range(256)), dtype=bool, count=256)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    return _tables(size)[0][:n], _tables(size)[1][:n]


@cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(size, np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers with their bits spread, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _runs(units: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of units that are inside, where it starts)."""
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    up, down = _powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def in_groups(texts: list, size=len) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts that together have about CHARACTERS characters; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = size(t) if t else 0
        if held and held + n > CHARACTERS:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-case words of all texts in order, how many each text has); a word is a run of letters, digits and underscores."""
    lowered = [t.lower() if t else "" for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), dtype="<u4")
    hashes, starts = _runs(points, _word_characters()[points])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The same of UTF-8 texts whose words stand between ASCII white space, with A to Z as lower case."""
    lowered = [t.lower() if t else b"" for t in texts]
    units = np.frombuffer(b"\n".join(lowered), dtype=np.uint8)
    hashes, starts = _runs(units, _not_space()[units])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)
