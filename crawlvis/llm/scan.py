"""Vectorised scanning of text: code points, character classes and word boundaries for whole batches.

Texts are laid end to end as one array of code points, so that splitting a batch takes a few numpy
passes instead of a regular-expression match for each word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points that one scan covers at most, unless a single text is longer.
SCAN_POINTS = 2_000_000

# The code points with the Unicode property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


@cache
def classes() -> np.ndarray:
    """The class of every code point, by general category."""
    table = np.zeros(0x110000, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        table[point] = kinds.get(unicodedata.category(chr(point))[0], OTHER)
    table[list(WHITE_SPACE)] = SPACE
    return table


@cache
def marks() -> np.ndarray:
    """True for combining marks, which belong to the word before them."""
    return np.fromiter((unicodedata.category(chr(p))[0] == "M" for p in range(0x110000)), dtype=bool, count=0x110000)


class Scan:
    """Code points of several texts end to end, with the place of each text."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.data = joined.encode("utf-8", "surrogatepass")
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.kinds = classes()[self.points]
        self.first = np.zeros(len(self.points) + 1, dtype=bool)
        self.first[self.starts] = True

    def bytes_at(self, places: np.ndarray) -> np.ndarray:
        """The byte offsets of code point offsets."""
        widths = 1 + (self.points >= 0x80) + (self.points >= 0x800) + (self.points >= 0x10000)
        return np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))[places]

    def strings(self, cuts: np.ndarray) -> pa.StringArray:
        """The pieces between consecutive cuts, sharing the texts' bytes. The first cut is 0 and the last the end."""
        offsets = self.bytes_at(cuts).astype(np.int32)
        return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets), pa.py_buffer(self.data))

    def owners(self, places: np.ndarray) -> np.ndarray:
        """How many of the sorted places lie before each text's start, and in all: a CSR index of texts."""
        return np.searchsorted(places, self.starts)

    def contractions(self, token_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apostrophes that open one of 's 't 're 've 'm 'll 'd, and how many code points each covers."""
        at = np.flatnonzero((self.points == 0x27) & token_start)
        n = len(self.points)
        one, two = np.zeros(len(at), dtype=np.uint32), np.zeros(len(at), dtype=np.uint32)
        has = (at + 1 < n) & ~self.first[np.minimum(at + 1, n)]
        one[has] = self.points[at[has] + 1]
        more = has & (at + 2 < n) & ~self.first[np.minimum(at + 2, n)]
        two[more] = self.points[at[more] + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        width = np.where(short, 2, np.where(long, 3, 0))
        return at[width > 0], width[width > 0]

    def _cut(self, start: np.ndarray, open_run: np.ndarray) -> np.ndarray:
        at, width = self.contractions(start & open_run)
        start[at + 1] = False
        ends = at + width
        start[ends[ends < len(start)]] = True
        return np.concatenate((np.flatnonzero(start), [len(self.points)]))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the class changes or a text begins; and the class before each place."""
        n = len(self.points)
        before = np.full(n, 255, dtype=np.uint8)
        before[1:] = self.kinds[:-1]
        before[self.first[:n]] = 255
        return self.kinds != before, before

    def byte_level_cuts(self) -> np.ndarray:
        """Cuts of the byte-level BPE pre-tokenizer: contractions, runs with one leading blank, white space."""
        n = len(self.points)
        if not n:
            return np.array([0])
        start, before = self.runs()
        space = self.kinds == SPACE
        inside = ~self.first[1:]  # whether the next code point is of the same text
        last_space = space.copy()
        last_space[:-1] &= ~space[1:] & inside[:-1]
        last_space[-1] = False
        blank_before = np.zeros(n, dtype=bool)
        blank_before[1:] = (self.points[:-1] == 0x20) & inside[:-1]
        start &= ~(blank_before & ~space)
        start |= last_space
        return self._cut(start, self.kinds == OTHER)

    def word_end_cuts(self) -> np.ndarray:
        """Cuts of the word-end BPE pre-tokenizer, white space being pieces of its own: each number stands alone."""
        if not len(self.points):
            return np.array([0])
        start, _ = self.runs()
        start |= self.kinds == NUMBER
        return self._cut(start, self.kinds == OTHER)

    def word_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Cuts between words (runs of letters, numbers and marks) and what lies between; and which pieces are words."""
        if not len(self.points):
            return np.array([0]), np.zeros(0, dtype=bool)
        word = (self.kinds == LETTER) | (self.kinds == NUMBER) | marks()[self.points]
        start = self.first[:-1].copy()
        start[1:] |= word[1:] != word[:-1]
        at = np.flatnonzero(start)
        return np.concatenate((at, [len(self.points)])), word[at]


def scans(texts: list[str], limit: int = SCAN_POINTS) -> Iterator[tuple[int, int, Scan]]:
    """Scans over consecutive texts, each of at most ``limit`` code points unless one text alone is longer."""
    begin, points = 0, 0
    for i, text in enumerate(texts):
        if points and points + len(text) > limit:
            yield begin, i, Scan(texts[begin:i])
            begin, points = i, 0
        points += len(text)
    if begin < len(texts):
        yield begin, len(texts), Scan(texts[begin:])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of the ranges that begin at ``starts`` and have ``lengths``, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    step = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return step + np.arange(total)
