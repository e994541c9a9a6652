"""Automatic numbers of bins: rule of thumb, and direct plug-in from grouped sums only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.exprs import inverse_density_squared
from .clean import Clean
from .fit import fit_bins, hat_basis, indicator_basis, solve
from .intervals import std_errors
from .moments import bin_moments, cell_sums, gram
from .quantiles import assign, edges_of, exact_quantiles, interior_edges


def rule_of_thumb(data: Clean) -> int:
    """Bins from a global linear fit and a Gaussian density for x."""
    n = data.n
    if n <= 1:
        raise ValueError("at least two rows are needed to choose a number of bins")
    if data.low == data.high:
        raise ValueError("Could not produce at least 2 bins; check the distribution of the x column.")
    features = [data.x, *data.w]
    _, g = gram(data.df, [*features, inverse_density_squared(data.x)], data.y)
    density = g[0, -2]
    keep = [i for i in range(len(g)) if i != len(g) - 2]
    g = g[np.ix_(keep, keep)]
    if data.groups:
        cells, sums = cell_sums(data.df, data.groups, [*features, data.y], data.categorical)
        level = cells.level_sums(sums)
        within = g[1:, 1:] - level.T @ cells.solve(level)
        within = (within + within.T) / 2
        theta = solve(within[:-1, :-1], within[:-1, -1])
        slope, rss = theta[0], within[-1, -1] - theta @ within[:-1, :-1] @ theta
    else:
        theta = solve(g[:-1, :-1], g[:-1, -1])
        slope, rss = theta[1], g[-1, -1] - theta @ g[:-1, :-1] @ theta
    bias, variance = slope**2 * density / n / 12, rss / n
    if not math.isfinite(bias) or bias <= 0:
        raise ValueError("the rule of thumb finds no slope; give a number of bins")
    if not math.isfinite(variance) or variance < 0:
        variance = 0.0
    if variance == 0:
        return min(max(2, n // 10), max(2, n))
    return min(max(2, n // 10), max(2, round((2 * bias / variance) ** (1 / 3) * n ** (1 / 3))))


def plug_in_constants(data: Clean, pilot: int) -> tuple[float, float] | None:
    """(bias, variance) at a pilot number of bins; None where the pilot has too few bins.

    The bias is the variation of a broken-line fit within bins, the variance the
    mean of the squared standard errors of the bins' levels; both need sums per bin only.
    """
    edges, bins = edges_of(exact_quantiles(data.df, "_x", pilot, data.n, data.distinct))
    if len(edges) < 3:
        return None
    data = data.binned(assign(data.df, interior_edges(edges, data.low, data.high)))
    bin_ = F.col("_b")
    m = bin_moments(data, bin_, bins)
    n_bin = m.per_bin(m.s1)
    if (n_bin[:, 0] == 0).any():
        return None
    knots = (np.array(edges) - data.mean["_x"]) / data.scale["_x"]
    slope = fit_bins(m, hat_basis(knots)).curve()[1]
    s2 = m.per_bin(m.s2)
    within = s2[:, 1, 1] - n_bin[:, 1] ** 2 / n_bin[:, 0]
    bias = float((slope**2 * np.maximum(within, 0)).sum() / m.n * bins**2)
    se = std_errors(data, bin_, fit_bins(m, indicator_basis(bins)), m)
    return bias, float((n_bin[:, 0] * se**2).sum() / m.n / bins)


def direct_plug_in(data: Clean) -> int:
    """Bins that balance the estimated bias and variance at the rule of thumb's number."""
    pilot = rule_of_thumb(data)
    if data.n < 5:
        return pilot
    constants = plug_in_constants(data, pilot)
    if constants is None or not all(math.isfinite(c) and c > 0 for c in constants):
        return pilot
    bias, variance = constants
    return max(2, math.ceil((2 * bias / variance) ** (1 / 3)))
