"""Absorbing categorical controls, from group sums only.

The rows that share all their categorical levels are one cell. Projecting a
column on the levels needs its sums per level only: with D the incidence of
cells and levels, (D'D) a = D'v, and row effects of a cell are the sums of its
levels' a. One factor is a division by counts; a few levels are solved densely;
many by conjugate gradients on all columns at once, preconditioned by counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of sums per combination of levels (and bin) that the driver takes.
MAX_BYTES = 2 << 30
DENSE_LEVELS = 400
TOLERANCE = 1e-11
MAX_ITERATIONS = 10_000


@dataclass(frozen=True)
class Grouped:
    """Groups of rows: the code of each factor's level, the levels, further keys, and sums."""

    codes: np.ndarray
    levels: list[pa.Array]
    keys: dict[str, np.ndarray]
    sums: dict[str, np.ndarray]


class Cells:
    """Codes of the levels of each cell, and the cells' counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, names: Sequence[str] = ()):
        self.names = tuple(names)
        self.counts = np.asarray(counts, np.float64)
        self.n = float(self.counts.sum())
        self.codes = np.empty(codes.shape, np.int64)
        self.sizes = []
        for f in range(codes.shape[1]):
            _, self.codes[:, f] = np.unique(codes[:, f], return_inverse=True)
            self.sizes.append(int(self.codes[:, f].max()) + 1 if len(codes) else 0)
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.flat = self.codes + self.offset[:-1]
        self.weight = np.zeros(self.offset[-1])
        for f in range(codes.shape[1]):
            self.weight += np.bincount(self.flat[:, f], self.counts, self.offset[-1])

    def level_sums(self, cell_sums: np.ndarray) -> np.ndarray:
        """D'v from the sums of v per cell (columns are variables)."""
        out = np.zeros((self.offset[-1], cell_sums.shape[1]))
        for f in range(self.flat.shape[1]):
            np.add.at(out, self.flat[:, f], cell_sums)
        return out

    def effects(self, levels: np.ndarray) -> np.ndarray:
        """The sum of a cell's levels, per variable."""
        return sum(levels[self.flat[:, f]] for f in range(self.flat.shape[1]))

    def _apply(self, levels: np.ndarray) -> np.ndarray:
        return self.level_sums(self.effects(levels) * self.counts[:, None])

    def solve(self, right: np.ndarray) -> np.ndarray:
        """Levels a with D'D a = right, for consistent right-hand sides."""
        if self.flat.shape[1] == 1:
            return right / self.weight[:, None]
        if self.offset[-1] <= DENSE_LEVELS:
            dense = self._apply(np.eye(self.offset[-1]))
            return np.linalg.lstsq(dense, right, rcond=1e-13)[0]
        a = np.zeros_like(right)
        residual = right.copy()
        size = np.sqrt((right**2).sum(axis=0))
        size[size == 0] = 1.0
        z = residual / self.weight[:, None]
        step, rho = z.copy(), (residual * z).sum(axis=0)
        for _ in range(MAX_ITERATIONS):
            if (np.sqrt((residual**2).sum(axis=0)) <= TOLERANCE * size).all():
                return a
            moved = self._apply(step)
            slope = (step * moved).sum(axis=0)
            alpha = np.divide(rho, slope, out=np.zeros_like(rho), where=slope > 0)
            a += alpha * step
            residual -= alpha * moved
            z = residual / self.weight[:, None]
            new = (residual * z).sum(axis=0)
            step = z + np.divide(new, rho, out=np.zeros_like(new), where=rho > 0) * step
            rho = new
        raise ValueError(f"absorbing {', '.join(self.names) or 'the categorical controls'} did not converge")

    def components(self) -> int:
        """Connected components of the levels, two levels being tied where a cell holds both."""
        label = np.arange(self.offset[-1])
        while True:
            low = label[self.flat].min(axis=1)
            new = label.copy()
            for f in range(self.flat.shape[1]):
                np.minimum.at(new, self.flat[:, f], low)
            new = new[new]
            if (new == label).all():
                return len(np.unique(label))
            label = new

    def rank(self) -> int:
        """Levels less what is redundant (exact for one and two factors, a bound beyond)."""
        return int(self.offset[-1]) - self.components() * (self.flat.shape[1] - 1)


def grouped(df: DataFrame, groups: Sequence[str], names: Sequence[str], more: Sequence[str], sums: dict[str, Column]) -> Grouped:
    """Sums per observed combination of levels (and of the integer keys ``more``), as arrays.

    One aggregation; its rows are counted where they are before any of them is
    collected, and refused beyond ``MAX_BYTES`` of what the driver would hold.
    """
    keys = [*groups, *more]
    rows = df.groupBy(*keys).agg(*[F.sum(c).alias(f"s_{a}") for a, c in sums.items()])
    if groups:
        rows = rows.persist()
        try:
            n = rows.count()
            size = n * 8 * (len(keys) + 2 * len(sums))
            if size > MAX_BYTES:
                raise ValueError(f"{', '.join(names)}: {n} combinations of levels need {size >> 20} MB, of {MAX_BYTES >> 20} allowed")
            if n == 0:
                raise ValueError("no cells to absorb")
            table = rows.toArrow()
        finally:
            rows.unpersist()
    else:
        table = rows.toArrow()
    codes, levels = np.zeros((table.num_rows, len(groups)), np.int64), []
    for f, g in enumerate(groups):
        column = pc.dictionary_encode(table.column(g).combine_chunks())
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes[:, f] = column.indices.to_numpy(zero_copy_only=False)
        levels.append(column.dictionary)
    got = {a: table.column(f"s_{a}").to_numpy().astype(np.float64) for a in sums}
    return Grouped(codes, levels, {k: table.column(k).to_numpy().astype(np.int64) for k in more}, got)


def match(first: Grouped, again: Grouped) -> np.ndarray:
    """For each group of ``again``, a group of ``first`` with the same levels; -1 where there is none."""
    codes = np.empty_like(again.codes)
    for f, level in enumerate(again.levels):
        place = pc.index_in(level, value_set=first.levels[f])
        codes[:, f] = place.fill_null(-1).to_numpy(zero_copy_only=False)[again.codes[:, f]]
    _, both = np.unique(np.concatenate([first.codes, codes]), axis=0, return_inverse=True)
    both = both.ravel()
    where = np.full(both.max(initial=0) + 1, -1)
    where[both[: len(first.codes)]] = np.arange(len(first.codes))
    return where[both[len(first.codes) :]]


def crosstab(df: DataFrame, groups: Sequence[str], bin_column: str | None = None) -> DataFrame:
    """Counts of each observed combination of levels (and bin)."""
    keys = [*groups, *([bin_column] if bin_column else [])]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
