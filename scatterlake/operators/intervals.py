"""Heteroskedasticity-robust intervals: a second pass over residuals, as grouped sums.

The meat of the sandwich needs e**2 times products of design columns. The
absorbed part of a residual is constant in a cell, so sums of the unabsorbed
residual r under weights 1, r and r**2 per (cell, bin) give those of e = r - o
without joining cell effects to rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import affine, weighted
from .clean import Clean
from .fit import BinFit
from .fixed_effects import Grouped, grouped, match
from .moments import BinMoments, _pairs


TWO_PASSES = "the two passes saw different groups; persist the input or make it deterministic"


@dataclass(frozen=True)
class Intervals:
    center: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    std_error: np.ndarray


def z_value(level: float) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def _weighted_moments(data: Clean, bin_: Column, fit: BinFit, m: BinMoments) -> Grouped:
    """Per group, for each power p of r that is needed: n, x, xx, w, xw and (summed per cell) ww."""
    x, w = data.x, data.w
    k = len(w)
    level, slope = fit.curve()
    r = data.y - affine(F.col("_bin"), x, level, slope)
    if k:
        r = r - weighted(w, fit.theta[fit.size :])
    df = data.df.withColumn("_bin", bin_).withColumn("_r", r)
    powers = [2] if m.cells is None else [0, 1, 2]
    weight = {0: F.lit(1.0), 1: F.col("_r"), 2: F.col("_r") * F.col("_r")}
    sums = {}
    for p in powers:
        e = weight[p]
        sums |= {f"{p}n": e, f"{p}x": e * x, f"{p}xx": e * x * x}
        for i in range(k):
            sums |= {f"{p}w{i}": e * w[i], f"{p}xw{i}": e * x * w[i]}
        for i, j in _pairs(k):
            sums[f"{p}w{i}_{j}"] = e * w[i] * w[j]
    got = grouped(df, list(data.groups), data.categorical, ["_bin"], sums)
    if len(got.keys["_bin"]) != len(m.bin):
        raise ValueError(TWO_PASSES)
    return got


def meat(data: Clean, bin_: Column, fit: BinFit, m: BinMoments) -> np.ndarray:
    """Sum over rows of e**2 times the outer product of the (re-centred) design row."""
    again, size, k = _weighted_moments(data, bin_, fit, m), fit.size, len(data.w)
    got, at = again.sums, again.keys["_bin"]
    if m.cells is None:
        offset, shift = np.zeros(len(at)), np.zeros((len(at), size + k))
        power = lambda a: got[f"2{a}"]
    else:
        offset, shift = _cell_parts(fit, m, again)
        power = lambda a: got[f"2{a}"] - 2 * offset * got[f"1{a}"] + offset**2 * got[f"0{a}"]
    s1 = np.stack([power("n"), power("x")], axis=1)
    s2 = np.stack([s1, np.stack([power("x"), power("xx")], axis=1)], axis=1)
    sw = np.zeros((len(at), 2, k))
    for i in range(k):
        sw[:, 0, i], sw[:, 1, i] = power(f"w{i}"), power(f"xw{i}")
    out = np.zeros((size + k, size + k))
    per_bin = lambda v: _by_bin(at, v, len(fit.x_mean))
    out[:size, :size] = np.einsum("jpb,jpq,jqc->bc", fit.basis, per_bin(s2), fit.basis)
    out[:size, size:] = np.einsum("jpb,jpk->bk", fit.basis, per_bin(sw))
    out[size:, :size] = out[:size, size:].T
    for i, j in _pairs(k):
        out[size + i, size + j] = out[size + j, size + i] = power(f"w{i}_{j}").sum()
    if m.cells is not None:
        # design rows are a - shift: expand the outer product
        linear = np.hstack([np.einsum("gpb,gp->gb", fit.basis[at], s1), sw[:, 0]])
        cross = linear.T @ shift
        out += -cross - cross.T + (shift * power("n")[:, None]).T @ shift
    return (out + out.T) / 2


def _by_bin(at: np.ndarray, values: np.ndarray, bins: int) -> np.ndarray:
    out = np.zeros((bins, *values.shape[1:]))
    np.add.at(out, at, values)
    return out


def _cell_parts(fit: BinFit, m: BinMoments, again: Grouped) -> tuple[np.ndarray, np.ndarray]:
    """Offset and design shift of each group of the second pass, by the cells' levels."""
    group = match(m.groups, again)
    if (group < 0).any():
        raise ValueError(TWO_PASSES)
    mine = m.cell[group]
    return fit.offset[mine], fit.cell_mean[mine] - fit.design_mean


def covariance(data: Clean, bin_: Column, fit: BinFit, m: BinMoments) -> np.ndarray:
    """HC1 covariance of theta."""
    used = fit.size + len(data.w) + (fit.rank - 1 if m.cells is not None else 0)
    dof = max(fit.n - used, 1)
    return fit.inverse @ meat(data, bin_, fit, m) @ fit.inverse * (fit.n / dof)


def std_errors(data: Clean, bin_: Column, fit: BinFit, m: BinMoments) -> np.ndarray:
    at = fit.at_bins()
    return np.sqrt(np.maximum(np.einsum("ja,ab,jb->j", at, covariance(data, bin_, fit, m), at), 0))


def intervals(data: Clean, bin_: Column, fit: BinFit, m: BinMoments, level: float) -> Intervals:
    """Intervals of the fit at each bin's mean of x, in units of y."""
    center = (fit.at_bins() @ fit.theta) * data.scale["_y"] + data.mean["_y"]
    se = std_errors(data, bin_, fit, m) * data.scale["_y"]
    z = z_value(level)
    return Intervals(center, center - z * se, center + z * se, se)
