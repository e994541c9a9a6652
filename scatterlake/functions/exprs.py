"""Column expressions of the statistical operators; all stay inside generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_CAP = 1.96


def column(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite (NaN compares as larger than all numbers)."""
    return c.isNotNull() & (F.abs(c) < F.lit(math.inf))


def scaled(c: Column, mean: float, scale: float) -> Column:
    return (c - F.lit(mean)) / F.lit(scale)


def inverse_density_squared(z: Column) -> Column:
    """1 / phi(z)**2 of a standard normal density with z capped, so that tails do not dominate."""
    return F.exp(F.least(z * z, F.lit(Z_CAP**2))) * F.lit(2 * math.pi)


def step(x: Column, edge: float) -> Column:
    return (x >= F.lit(edge)).cast("double")


def bin_index(x: Column, interior: Sequence[float]) -> Column:
    """Number of interior edges at or below x: left-closed bins with open ends."""
    if not len(interior):
        return F.lit(0)
    terms = [step(x, float(e)).cast("int") for e in interior]
    return sum(terms[1:], terms[0])


def bin_index_of_many(x: Column, interior: Sequence[float], width: int) -> Column:
    """The same for many edges: compare with every ``width``-th edge, then with the edges of one run."""
    edges = [float(e) for e in interior]
    runs = [edges[i : i + width] for i in range(0, len(edges), width)]
    heads = [r[0] for r in runs[1:]]
    run = F.element_at(F.array(*[F.array(*[F.lit(e) for e in r]) for r in runs]), bin_index(x, heads) + 1)
    return bin_index(x, heads) * F.lit(width) + F.size(F.filter(run, lambda e: x >= e))


def per_bin(bin_: Column, values: Sequence[float]) -> Column:
    """The value of a row's bin."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), bin_ + 1)


def affine(bin_: Column, x: Column, level: Sequence[float], slope: Sequence[float]) -> Column:
    """The row's fitted value of a curve that is affine in x within each bin."""
    out = per_bin(bin_, level)
    return out if not any(slope) else out + per_bin(bin_, slope) * x


def weighted(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of columns times numbers."""
    out = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        out = out + c * F.lit(float(w))
    return out
