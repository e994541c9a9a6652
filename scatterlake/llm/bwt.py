"""Merging Burrows-Wheeler transforms by interleave refinement.

Each shard of a collection of cyclic symbol strings is sorted on its own and kept
as its transform. A merge knows, after k rounds, the order of all rotations by
their first k symbols, as an interleaving of the shards' own orders (Holt and
McMillan, 2014): a round reads the transforms in the current interleaving and
deals the entries out by symbol. Each shard deals its own entries in an order that
never changes, so a round only counts, for every entry, how many entries of the
other shards with the same or a smaller symbol were read before it; nothing is
sorted again. Where two neighbours part in round k, their longest common prefix is
k - 1, so the blocks between such borders are the repeated intervals of depth k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Shard:
    """Strings laid end to end: symbols, and where each string begins (n+1 entries)."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, depth: int):
        n = len(symbols)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        lengths = np.diff(starts)
        some = lengths > 0
        following[starts[1:][some] - 1] = starts[:-1][some]
        before[starts[:-1][some]] = starts[1:][some] - 1
        rank, width, jump = symbols.astype(np.int64), 1, following
        while width < depth:
            pair = rank * (int(rank.max(initial=0)) + 1) + rank[jump]
            rank = np.unique(pair, return_inverse=True)[1]
            jump, width = jump[jump], width * 2
        self.order = np.argsort(rank, kind="stable")
        self.transform = symbols[before[self.order]]
        self.dealt = np.argsort(self.transform, kind="stable")  # the order in which this shard deals its entries


def merge(shards: list[Shard], depth: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For k = 1 .. depth: (places, blocks) of the merged order by the first k symbols.

    ``places`` holds the place of every entry of each shard, in that shard's own
    order. ``blocks`` numbers the intervals of equal prefixes.
    """
    sizes = [len(s.transform) for s in shards]
    total, ends = sum(sizes), np.cumsum(sizes)
    symbols = [s.transform[s.dealt].astype(np.int64) for s in shards]
    places = [np.arange(end - n, end) for n, end in zip(sizes, ends, strict=True)]
    block = np.zeros(total, np.int32)
    symbol, inside = np.empty(total, np.int64), np.empty(total, np.int32)
    for _ in range(depth):
        read = [at[s.dealt] for s, at in zip(shards, places, strict=True)]
        keys = [c * total + r for c, r in zip(symbols, read, strict=True)]  # rising in each shard
        places = [
            np.arange(len(mine)) + sum(np.searchsorted(other, mine) for j, other in enumerate(keys) if j != i)
            for i, mine in enumerate(keys)
        ]
        for at, c, r in zip(places, symbols, read, strict=True):
            symbol[at], inside[at] = c, block[r]
        border = np.ones(total, bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (inside[1:] != inside[:-1])
        block = np.cumsum(border, dtype=np.int32) - 1
        yield places, block


def positions(shards: list[Shard], places: list[np.ndarray]) -> np.ndarray:
    """Position, in all shards laid end to end, of each entry of a merged order."""
    out, base = np.empty(sum(map(len, places)), np.int64), 0
    for s, at in zip(shards, places, strict=True):
        out[at] = s.order + base
        base += len(s.order)
    return out


def transform(shards: list[Shard], places: list[np.ndarray]) -> np.ndarray:
    """The merged collection's transform, from the final interleaving."""
    out = np.empty(sum(map(len, places)), np.int32)
    for s, at in zip(shards, places, strict=True):
        out[at] = s.transform
    return out
