"""Byte-level pre-tokens: vectorised splitting, and encoding of each distinct pre-token once.

The split is that of the public pattern (contractions, then letters, numbers and other
characters, each with an optional leading space, then white space), found from character
classes instead of a regular expression.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd

from .arrow_text import SpanHasher, code_points

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Unicode White_Space, fixed by the standard.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

#: Endings of the contractions that the pattern takes first, with their lengths.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    names = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    classes[names == "L"] = LETTER
    classes[names == "N"] = NUMBER
    classes[WHITE_SPACE] = SPACE
    return classes


def pretoken_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of several texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = character_classes()[points]
    text_start = np.zeros(n, bool)
    text_start[starts[:-1][starts[:-1] < n]] = True
    text_end = np.zeros(n, bool)  # the last position of a text
    text_end[:-1] = text_start[1:]
    text_end[-1] = True
    change = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= text_start
    space = kind == SPACE
    # The last white-space character before other text stands alone or leads the next token.
    last_space = np.zeros(n, bool)
    last_space[:-1] = space[:-1] & ~space[1:]
    last_space &= ~text_end
    led = np.zeros(n, bool)  # a plain space before it belongs to this token
    led[1:] = last_space[:-1] & (points[:-1] == 32)
    begins = np.where(space, change | last_space, change & ~led)
    begins |= text_start
    quotes = np.flatnonzero((points == 39) & begins)
    if len(quotes):
        quotes = quotes[~text_end[quotes]]
        quotes = quotes[kind[quotes + 1] == LETTER]
        first = points[quotes + 1]
        second = points[np.minimum(quotes + 2, n - 1)].copy()
        second[text_end[quotes + 1]] = 0
        taken = np.zeros(len(quotes), np.int64)
        for ending in reversed(CONTRACTIONS):
            match = first == ord(ending[0])
            if len(ending) == 2:
                match &= second == ord(ending[1])
            taken[match] = len(ending)
        quotes, taken = quotes[taken > 0], taken[taken > 0]
        begins[quotes + 1] = False
        after = quotes + 1 + taken
        inside = ~text_end[after - 1]
        begins[after[inside]] |= kind[after[inside]] == LETTER
    return np.flatnonzero(begins)


class PretokenEncoder:
    """Encodes texts through a memory of distinct pre-tokens.

    ``encode`` maps a list of strings to lists of ids.  The memory is emptied when it holds
    more than ``limit`` entries; that bounds the worker's memory and doesn't affect results.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, keys: list[int], strings: list[str]) -> None:
        found = self.encode(strings)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for one in found for i in one), np.uint32, int(sizes.sum()))
        first = len(self.known)
        while first + len(keys) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[first : first + len(keys)] = sizes
        self.start[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's first place with the total at the end."""
        if len(self.known) > self.limit:
            self._clear()
        points, starts = code_points(texts)
        begin = pretoken_starts(points, starts)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        end = np.append(begin[1:], len(points))
        codes, keys = pd.factorize(SpanHasher(points)(begin, end))
        slots = [self.known.get(key, -1) for key in keys.tolist()]
        slots = np.array(slots, np.int64)
        if (missing := np.flatnonzero(slots < 0)).size:
            first = np.zeros(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            joined = "".join(texts)
            at = first[missing]
            strings = [joined[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            slots[missing] = len(self.known) + np.arange(len(missing))
            self._learn(keys[missing].tolist(), strings)
        slot = slots[codes]
        size = self.size[slot]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        source = np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])
        return self.ids[source], total[np.searchsorted(begin, starts)]


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for those
    from U+0100 on; fixed by the vocabularies' format.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [], 256
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


@lru_cache(maxsize=1)
def _letter_table() -> dict[int, str]:
    return dict(enumerate(byte_letters()))


def spelled(text: str) -> str:
    """A string's UTF-8 bytes in the letters of ``byte_letters``."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_letter_table())
