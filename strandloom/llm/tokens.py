"""Words of many texts at once, as 64-bit codes.

Texts are joined into stretches and cut in numpy: a table says which code points are
letters or digits and gives each a random value; a word's code is the polynomial of
its values, read off one running sum, and mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Characters of a stretch; a text that is longer is cut between words.
STRETCH = 1 << 18
_BREAK = re.compile(r"[\W_]")
_RADIX = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _values() -> np.ndarray:
    """A random odd value for each letter or digit, zero for other code points."""
    word = np.frombuffer(bytes(chr(i).isalnum() for i in range(0x110000)), bool)
    return np.where(word, mix(np.arange(1, len(word) + 1, dtype=np.uint64) * np.uint64(_RADIX)) | np.uint64(1), np.uint64(0))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the radix and of its inverse up to ``n``."""

    def of(base: int) -> np.ndarray:
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return of(_RADIX), of(pow(_RADIX, -1, 1 << 64))


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, str]]:
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while len(text) - at > STRETCH and (cut := _BREAK.search(text, at + STRETCH)):
            yield i, text[at : cut.start()]
            at = cut.start()
        yield i, text[at:]


def stretches(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(codes, owner)``: the words in order and the number of the text each is of.

    A word is a run of letters and digits of the text in lower case, as in ``[^\\W_]+``.
    A text's words follow each other, from one stretch to the next.
    """
    held: list[str] = []
    own: list[int] = []
    size = 0
    for i, piece in _pieces(texts):
        held.append(piece)
        own.append(i)
        size += len(piece) + 1
        if size >= STRETCH:
            yield _codes(held, own)
            held, own, size = [], [], 0
    if held:
        yield _codes(held, own)


def _codes(pieces: list[str], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    value = _values()[points]
    edge = np.flatnonzero(np.diff((value != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    size = max(STRETCH * 2, 1 << len(points).bit_length())
    up, down = _powers(size)
    value *= up[: len(value)]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    codes = mix((upto[end] - upto[start]) * down[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
    return codes, np.asarray(own, np.int64)[np.searchsorted(begins, start, "right") - 1]


class Lookup:
    """Places of evenly spread 64-bit keys: a table by their upper bits points into the sorted keys."""

    def __init__(self, keys: np.ndarray):
        """``keys`` are sorted and distinct."""
        self.keys, bits = keys, max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        self.first = np.append(self.first, self.first.dtype.type(len(keys)))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code among the keys, or -1."""
        slot = codes >> self.shift
        at, end = self.first[slot], self.first[slot + np.uint64(1)]
        out = np.full(len(codes), -1, at.dtype)
        live = np.flatnonzero(at < end)
        at, end, codes = at[live], end[live], codes[live]
        while len(live):
            same = self.keys[at] == codes
            out[live[same]] = at[same]
            more = ~same & (at + 1 < end)
            live, at, end, codes = live[more], at[more] + 1, end[more], codes[more]
        return out
