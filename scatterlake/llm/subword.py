"""Character n-grams of the words of whole documents, without a Python loop over characters.

Texts become code points, words are runs of letters (any script, lower-cased) with a
boundary mark at each end, and n-grams are hashed once for each distinct word of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

from .common import mix, powers

_MARK = 32  # the boundary of a word
_GRAM = np.uint64(0x9E3779B97F4A7C15)
#: Code points of text worked on at once; a longer text is one piece of its own.
PIECE = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass(frozen=True)
class Words:
    """Distinct words of a piece, how often each document has them, and the n-gram slots of each word."""

    docs: int
    doc: np.ndarray  # of each (document, word) pair, sorted by document
    word: np.ndarray
    count: np.ndarray
    first: np.ndarray  # where the slots of each word begin (one entry more than words)
    slots: np.ndarray

    def pair_slots(self) -> tuple[np.ndarray, np.ndarray]:
        """For all n-grams of all pairs, pair by pair: the place of the pair and the slot."""
        size = np.diff(self.first)[self.word]
        pair = np.repeat(np.arange(len(self.word)), size)
        ends = np.cumsum(size)
        inside = np.arange(len(pair)) - np.repeat(ends - size, size)
        return pair, self.slots[self.first[self.word][pair] + inside]


def _pieces(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        t = (t or "").lower()
        if part and size + len(t) > PIECE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def words_of(texts: list[str | None], sizes: tuple[int, ...], bits: int) -> Iterator[Words]:
    """The words of runs of whole documents, about ``PIECE`` code points at a time; null is empty."""
    for part in _pieces(texts):
        yield _words(part, sizes, bits)


def _words(texts: list[str], sizes: tuple[int, ...], bits: int) -> Words:
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    body = _is_letter()[code]
    edge = np.flatnonzero(np.diff(body, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    prefix = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code + np.uint64(1)) * powers(len(code))[0][: len(code)], out=prefix[1:], dtype=np.uint64)
    hashed = mix((prefix[stop] - prefix[start]) * powers(len(code))[1][start] + (stop - start).astype(np.uint64))
    distinct, at, which = np.unique(hashed, return_index=True, return_inverse=True)
    doc = np.searchsorted(ends, start, side="right")
    pairs, count = np.unique(doc * max(1, len(distinct)) + which, return_counts=True)
    doc, word = np.divmod(pairs, max(1, len(distinct)))
    first, slots = _grams(code, start[at], stop[at], sizes, bits)
    return Words(len(texts), doc, word, count, first, slots)


def _grams(code: np.ndarray, start: np.ndarray, stop: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of words [start, stop), with a boundary mark before and behind each."""
    length = stop - start + 2
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(owner)) - begin[owner]
    marked = np.where((inside == 0) | (inside == length[owner] - 1), 0, inside - 1)
    chars = code[np.minimum(start[owner] + marked, max(0, len(code) - 1))].astype(np.uint64)
    chars[(inside == 0) | (inside == length[owner] - 1)] = _MARK
    left = length[owner] - inside  # characters from here to the end of the word
    who, found, rolled = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(sizes) + 1):
        rolled = rolled * _GRAM
        rolled[: max(0, len(chars) - n + 1)] += chars[n - 1 :] + np.uint64(1)
        if n in sizes:
            ok = np.flatnonzero(left >= n)
            if n == 1:
                ok = ok[chars[ok] != _MARK]
            who.append(owner[ok])
            found.append((mix(rolled[ok] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
    who, found = np.concatenate(who), np.concatenate(found)
    order = np.argsort(who, kind="stable")
    return np.searchsorted(who[order], np.arange(len(length) + 1)), found[order]
