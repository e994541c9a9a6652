"""Sums of products: everything a fit needs, in one grouped aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import Clean
from .fixed_effects import Cells, Grouped, grouped


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram(df: DataFrame, features: Sequence[Column], response: Column) -> tuple[int, np.ndarray]:
    """n and the matrix of sums of products of [1, features, response]."""
    cols = [F.lit(1.0), *features, response]
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i, j in _pairs(len(cols))]).first()
    out = np.zeros((len(cols), len(cols)))
    for i, j in _pairs(len(cols)):
        out[i, j] = out[j, i] = row[f"p{i}_{j}"] or 0.0
    return int(round(out[0, 0])), out


def cell_sums(df: DataFrame, groups: Sequence[str], columns: Sequence[Column], names: Sequence[str]) -> tuple[Cells, np.ndarray]:
    """The cells of ``groups`` and the columns' sums in each."""
    got = grouped(df, groups, names, [], {"n": F.lit(1.0)} | {str(i): c for i, c in enumerate(columns)})
    sums = np.stack([got.sums[str(i)] for i in range(len(columns))], axis=1)
    return Cells(got.codes, got.sums["n"], names), sums


@dataclass
class BinMoments:
    """Sums per (cell, bin): n, y, x, xx, xy, w, xw; and the products of y and w over all rows.

    Without categorical controls there is one cell. x, y and w are centred and scaled.
    """

    bins: int
    cells: Cells | None
    cell: np.ndarray  # cell of each group
    bin: np.ndarray
    s1: np.ndarray  # groups x [1, x]: sums
    s2: np.ndarray  # groups x 2 x 2
    sy: np.ndarray  # groups x 2: sums of y, xy
    sw: np.ndarray  # groups x 2 x k
    yy: float
    wy: np.ndarray
    ww: np.ndarray
    n: int
    groups: Grouped

    def per_bin(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.bins, *values.shape[1:]))
        np.add.at(out, self.bin, values)
        return out

    def per_cell(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.cells.counts), *values.shape[1:]))
        np.add.at(out, self.cell, values)
        return out


def bin_moments(data: Clean, bin_: Column, bins: int) -> BinMoments:
    """One ``groupBy(*categoricals, bin)``; the per-bin and per-cell tables are roll-ups of it."""
    x, y, w = data.x, data.y, data.w
    k = len(w)
    df, groups = data.df, list(data.groups)
    sums = {"n": F.lit(1.0), "y": y, "yy": y * y, "x": x, "xx": x * x, "xy": x * y}
    for i in range(k):
        sums |= {f"w{i}": w[i], f"xw{i}": x * w[i], f"yw{i}": y * w[i]}
    for i, j in _pairs(k):
        sums[f"w{i}_{j}"] = w[i] * w[j]
    all_groups = grouped(df.withColumn("_bin", bin_), groups, data.categorical, ["_bin"], sums)
    got, at = all_groups.sums, all_groups.keys["_bin"]
    cells, cell = None, np.zeros(len(at), np.int64)
    if groups:
        unique, cell = np.unique(all_groups.codes, axis=0, return_inverse=True)
        cell = cell.ravel()
        cells = Cells(unique, np.bincount(cell, got["n"]), data.categorical)
    ww = np.zeros((k, k))
    for i, j in _pairs(k):
        ww[i, j] = ww[j, i] = got[f"w{i}_{j}"].sum()
    stack = lambda *a: np.stack([got[v] for v in a], axis=1) if a else np.zeros((len(at), 0))
    return BinMoments(
        bins, cells, cell, at,
        stack("n", "x"), np.stack([stack("n", "x"), stack("x", "xx")], axis=1), stack("y", "xy"),
        np.stack([stack(*[f"w{i}" for i in range(k)]), stack(*[f"xw{i}" for i in range(k)])], axis=1),
        float(got["yy"].sum()), np.array([got[f"yw{i}"].sum() for i in range(k)]), ww, int(round(got["n"].sum())),
        all_groups,
    )
