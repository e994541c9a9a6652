"""Elias-Fano sequences and an n-gram trie of monotone levels in one memory-mapped file.

Level 1 holds the contexts, level 2 their successors. A successor is stored
relative to its context: the sequence holds ``base(context) + successor`` with
bases that grow by the range of the context's successors, which makes the whole
level monotone, so each level is one Elias-Fano sequence. Pointers from contexts
to their successors are monotone too. Probabilities are quantised on a log scale.
"""

from __future__ import annotations

import json
import struct

import numpy as np

#: Steps of the quantiser in one factor of ten; code 0 means absent.
STEPS = 512


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: int, width: int):
        self.low, self.high, self.size, self.width = low, high, size, width
        bits = np.unpackbits(high, bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        # elements before each value of the high part: the k-th zero closes value k
        self.until = zeros - np.arange(len(zeros))

    @staticmethod
    def parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        bits = np.concatenate([bits, np.zeros(1, np.uint8)])
        low = np.zeros(n * width + 64, np.uint8)
        for k in range(width):
            low[np.arange(n) * width + k] = (values >> np.uint64(k)).astype(np.uint8) & 1
        return np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), n, width

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        return cls(*cls.parts(values))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        words = np.ndarray((len(self.low) - 7,), "<u8", np.ascontiguousarray(self.low), strides=(1,))
        got = words[bit >> 3] >> (bit & 7).astype(np.uint64)
        return got & np.uint64((1 << self.width) - 1)  # a width of up to 57 bits lies in eight bytes

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element not below each value, and whether it is equal."""
        values = np.asarray(values, np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        inside = high < len(self.until)
        bucket = np.minimum(high, len(self.until) - 1)
        end = np.where(inside, np.minimum(self.until[bucket], self.size), self.size)
        begin = np.where(inside, np.where(bucket > 0, np.minimum(self.until[np.maximum(bucket, 1) - 1], self.size), 0), self.size)
        want = values & np.uint64((1 << self.width) - 1)
        lo, hi = begin.copy(), end.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            below = self._low(mid) < want[active]
            lo[active] = np.where(below, mid + 1, lo[active])
            hi[active] = np.where(below, hi[active], mid)
            active = active[lo[active] < hi[active]]
        equal = lo < end
        equal[equal] = self._low(lo[equal]) == want[equal]
        return lo, equal

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        high = np.searchsorted(self.until, at, side="right")
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(at)


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1.. of probabilities in (0, 1]."""
    return (1 + np.minimum(np.rint(-np.log10(p) * STEPS), 65534)).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    """The quantised probability of a code; 0 for code 0."""
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / STEPS), 0.0)


class BigramTrie:
    """Quantised values of (context, successor) pairs, in Elias-Fano levels."""

    NAMES = ("contexts", "pointers", "successors")

    def __init__(self, buffer: np.ndarray):
        head = struct.unpack("<q", buffer[:8].tobytes())[0]
        self.layout = json.loads(buffer[8 : 8 + head].tobytes())
        body = 8 + head
        take = lambda a, b: buffer[body + a : body + b]
        self.levels = {k: EliasFano(take(*self.layout[k]["low"]), take(*self.layout[k]["high"]), self.layout[k]["size"], self.layout[k]["width"]) for k in self.NAMES}
        self.codes = take(*self.layout["codes"]).view("<u2")
        self.span = np.uint64(self.layout["span"])

    @staticmethod
    def layout_of(context: np.ndarray, successor: np.ndarray, p: np.ndarray) -> bytes:
        """The file of pairs sorted by context and successor, without repeats."""
        contexts, first = np.unique(context, return_index=True)
        span = int(successor.max(initial=0)) + 1
        rank = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(context))))
        levels = {
            "contexts": contexts,
            "pointers": np.append(first, len(context)),
            "successors": rank.astype(np.uint64) * np.uint64(span) + successor.astype(np.uint64),
        }
        layout, blobs, at = {"span": span}, [], 0

        def put(data: bytes) -> list[int]:
            nonlocal at
            data += b"\0" * (-len(data) % 8)
            blobs.append(data)
            at += len(data)
            return [at - len(data), at]

        for name, values in levels.items():
            low, high, size, width = EliasFano.parts(values)
            layout[name] = {"low": put(low.tobytes()), "high": put(high.tobytes()), "size": size, "width": width}
        layout["codes"] = put(quantise(p).astype("<u2").tobytes())
        head = json.dumps(layout).encode()
        head += b" " * (-len(head) % 8)
        return struct.pack("<q", len(head)) + head + b"".join(blobs)

    @classmethod
    def mapped(cls, path: str) -> BigramTrie:
        return cls(np.memmap(path, np.uint8, "r"))

    def codes_of(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 for those that the trie lacks."""
        out = np.zeros(len(context), np.uint16)
        if not self.levels["contexts"].size:
            return out
        rank, known = self.levels["contexts"].successor(context)
        known &= np.asarray(successor, np.uint64) < self.span
        at = np.flatnonzero(known)
        place, found = self.levels["successors"].successor(rank[at].astype(np.uint64) * self.span + np.asarray(successor, np.uint64)[at])
        out[at[found]] = self.codes[place[found]]
        return out

    def successors_of(self, context: int) -> np.ndarray:
        """All successors of one context, through the pointers."""
        rank, known = self.levels["contexts"].successor(np.array([context]))
        if not known[0]:
            return np.zeros(0, np.uint64)
        begin, end = self.levels["pointers"].get(np.array([rank[0], rank[0] + 1])).astype(np.int64)
        return self.levels["successors"].get(np.arange(begin, end)) - np.uint64(rank[0]) * self.span
