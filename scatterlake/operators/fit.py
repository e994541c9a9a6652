"""Least squares on bins: the adjusted means, their curve, and the polynomial overlay.

A fit regresses y on a basis of x, numeric controls w and absorbed categorical
controls. The basis is affine in x within each bin: bin indicators, or the hat
functions of a continuous broken line on the bin edges. Absorbed fits are
re-centred: every column loses its projection on the levels and gets its mean
back, so that levels and intercept come out of the same equations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from .clean import Clean
from .moments import BinMoments, cell_sums, gram

GRID = 200
UNTOLD = "a control is determined by the bins of x; its effect cannot be told from theirs"


def indicator_basis(bins: int) -> np.ndarray:
    """Coefficients of [1, x] in each bin: one basis function per bin."""
    out = np.zeros((bins, 2, bins))
    out[np.arange(bins), 0, np.arange(bins)] = 1
    return out


def hat_basis(edges: np.ndarray) -> np.ndarray:
    """Coefficients of [1, x] in each bin of the hat functions on the edges."""
    bins = len(edges) - 1
    out = np.zeros((bins, 2, bins + 1))
    for j in range(bins):
        lo, hi = edges[j], edges[j + 1]
        out[j, :, j] = [hi / (hi - lo), -1 / (hi - lo)]
        out[j, :, j + 1] = [-lo / (hi - lo), 1 / (hi - lo)]
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system, of least norm where it is singular; scaled by its diagonal first."""
    d = np.sqrt(np.maximum(np.diag(a), 0))
    d[d == 0] = 1.0
    scaled = a / np.outer(d, d)
    right = (b.T / d).T
    out = np.linalg.lstsq(scaled, right, rcond=1e-12)[0]
    return (out.T / d).T


@dataclass
class BinFit:
    """theta of [basis, w], with what inference needs again."""

    basis: np.ndarray
    theta: np.ndarray
    inverse: np.ndarray  # of the (re-centred) matrix of sums of products
    cell_mean: np.ndarray | None  # projection of each design column, per cell
    design_mean: np.ndarray
    offset: np.ndarray | None  # absorbed effect per cell, about its mean
    x_mean: np.ndarray  # per bin, on the fit's scale
    n: int
    rank: int

    @property
    def size(self) -> int:
        return self.basis.shape[2]

    def at_bins(self) -> np.ndarray:
        """Design rows at each bin's mean of x, with controls at their means (zero)."""
        point = np.stack([np.ones(len(self.x_mean)), self.x_mean], axis=1)
        rows = np.einsum("jp,jpb->jb", point, self.basis)
        return np.hstack([rows, np.zeros((len(rows), len(self.theta) - self.size))])

    def curve(self) -> tuple[np.ndarray, np.ndarray]:
        """Level and slope in each bin."""
        both = self.basis @ self.theta[: self.size]
        return both[:, 0], both[:, 1]


def fit_bins(m: BinMoments, basis: np.ndarray) -> BinFit:
    """Fit from grouped sums; the control means are zero, as all columns are centred."""
    size, k = basis.shape[2], len(m.wy)
    n_bin = m.per_bin(m.s1)
    if (n_bin[:, 0] == 0).any():
        raise ValueError("Quantiles are not unique. Decrease number of bins.")
    s2, sy, sw = m.per_bin(m.s2), m.per_bin(m.sy), m.per_bin(m.sw)
    a, b = np.zeros((size + k, size + k)), np.zeros(size + k)
    a[:size, :size] = np.einsum("jpb,jpq,jqc->bc", basis, s2, basis)
    a[:size, size:] = np.einsum("jpb,jpk->bk", basis, sw)
    a[size:, :size] = a[:size, size:].T
    a[size:, size:] = m.ww
    b[:size], b[size:] = np.einsum("jpb,jp->b", basis, sy), m.wy
    total = np.concatenate([np.einsum("jpb,jp->b", basis, n_bin), sw[:, 0].sum(axis=0)])
    mean, y_mean = total / m.n, sy[:, 0].sum() / m.n
    cell_mean = offset = None
    rank = 0
    if m.cells is not None:
        design = np.zeros((len(m.bin), size + k + 1))
        design[:, :size] = np.einsum("gpb,gp->gb", basis[m.bin], m.s1)
        design[:, size : size + k] = m.sw[:, 0]
        design[:, -1] = m.sy[:, 0]
        sums = m.cells.level_sums(m.per_cell(design))
        levels = m.cells.solve(sums)
        gone = sums.T @ levels
        gone = (gone + gone.T) / 2
        a = a - gone[:-1, :-1] + m.n * np.outer(mean, mean)
        b = b - gone[:-1, -1] + m.n * mean * y_mean
        projected = m.cells.effects(levels)
        cell_mean = projected[:, :-1]
        rank = m.cells.rank()
    inverse = solve(a, np.eye(len(a)))
    theta = inverse @ b if k == 0 and cell_mean is None else solve(a, b)
    if m.cells is not None:
        # effect of a cell beyond the mean that the re-centred fit already holds
        offset = projected[:, -1] - cell_mean @ theta - (y_mean - mean @ theta)
    if m.cells is None:
        _check_estimable(m, n_bin, sw, k)
    else:
        _check_estimable_within(m.n, a - m.n * np.outer(mean, mean), size)
    return BinFit(basis, theta, (inverse + inverse.T) / 2, cell_mean, mean, offset, n_bin[:, 1] / n_bin[:, 0], m.n, rank)


def _check_estimable(m: BinMoments, n_bin: np.ndarray, sw: np.ndarray, k: int) -> None:
    """Refuse controls whose effect the bins determine alone, so that the dots would be arbitrary.

    A combination of controls that does not vary within bins must not vary between
    them either; a repeated or constant control does neither and is harmless.
    """
    if not k:
        return
    means = sw[:, 0] / n_bin[:, :1]
    within = m.ww - (means * n_bin[:, :1]).T @ means
    values, vectors = np.linalg.eigh(within)
    null = vectors[:, values <= 1e-10 * max(1.0, m.n)]
    if null.size and np.abs(means @ null).max() > 1e-6:
        raise ValueError(UNTOLD)


def _check_estimable_within(n: int, within: np.ndarray, size: int) -> None:
    """The same with absorbed levels: ``within`` has the sums of products of [basis, w] about their projections.

    A combination of controls that varies within levels must not be a combination of the basis there.
    """
    if size == len(within):
        return
    bins, cross, own = within[:size, :size], within[:size, size:], within[size:, size:]
    left = own - cross.T @ np.linalg.lstsq(bins, cross, rcond=1e-10)[0]
    values, vectors = np.linalg.eigh((left + left.T) / 2)
    null = vectors[:, values <= 1e-10 * max(1.0, n)]
    if null.size and np.abs(np.diag(null.T @ own @ null)).max() > 1e-6 * n:
        raise ValueError(UNTOLD)


@dataclass(frozen=True)
class Polynomial:
    degree: int
    coefficients: tuple[float, ...]  # of powers of the original x, lowest first
    grid_x: tuple[float, ...]
    grid_y: tuple[float, ...]


def fit_polynomial(data: Clean, degree: int) -> Polynomial:
    """OLS of y on powers of x and the controls, evaluated on a grid at the controls' means."""
    x, y, w = data.x, data.y, data.w
    features = [x**p if p > 1 else x for p in range(1, degree + 1)] + w
    n, g = gram(data.df, features, y)
    a, b = g[:-1, :-1], g[:-1, -1]
    if data.groups:
        cells, sums = cell_sums(data.df, data.groups, [*features, y], data.categorical)
        level = cells.level_sums(sums)
        gone = level.T @ cells.solve(level)
        slope = solve(a[1:, 1:] - gone[:-1, :-1], b[1:] - gone[:-1, -1])
        theta = np.concatenate([[(b[0] - a[0, 1:] @ slope) / n], slope])
    else:
        theta = solve(a, b)
    powers = np.polynomial.Polynomial(theta[: degree + 1])
    grid = grid_of(data.low, data.high)
    z = (grid - data.mean["_x"]) / data.scale["_x"]
    fitted = powers(z) * data.scale["_y"] + data.mean["_y"]
    back = powers(np.polynomial.Polynomial([-data.mean["_x"] / data.scale["_x"], 1 / data.scale["_x"]]))
    coefficients = back.coef * data.scale["_y"]
    coefficients[0] += data.mean["_y"]
    coefficients = np.concatenate([coefficients, np.zeros(degree + 1 - len(coefficients))])
    return Polynomial(degree, tuple(coefficients.tolist()), tuple(grid.tolist()), tuple(fitted.tolist()))


def grid_of(low: float, high: float) -> np.ndarray:
    if not (np.isfinite(low) and np.isfinite(high)):
        raise ValueError("the range of x is not finite")
    return np.array([low]) if np.isclose(low, high) else np.linspace(low, high, GRID)


def bin_means(data: Clean, bin_, bins: int) -> list[tuple[int, int, float, float]]:
    """(bin, n, mean x, mean y) of every bin that has rows; sums are of centred values."""
    rows = data.df.groupBy(bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(data.x).alias("x"), F.avg(data.y).alias("y")).collect()
    return sorted((r["_bin"], r["n"], data.unscaled_x(r["x"]), r["y"] * data.scale["_y"] + data.mean["_y"]) for r in rows)
