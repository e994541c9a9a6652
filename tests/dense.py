"""Plain numpy versions of the estimators, on whole arrays, to hold the engine against."""

import math
from statistics import NormalDist

import numpy as np


def edges_and_bins(x, wanted):
    edges = list(dict.fromkeys(np.quantile(x, [i / wanted for i in range(wanted + 1)]).tolist()))
    inner = [e for e in edges[1:-1] if e != x.min()] or [x.max()]
    return edges, np.searchsorted(inner, x, side="right")


def one_hot(columns):
    out = []
    for c in columns:
        levels = sorted(set(c))
        out += [(np.asarray(c) == v).astype(float) for v in levels[1:]]
    return np.stack(out, axis=1) if out else None


def design(x, edges, bins, kind):
    j = bins.max() + 1
    if kind == "pointwise":
        return np.eye(j)[bins]
    e = np.array(edges)
    out = np.zeros((len(x), len(e)))
    left = (e[bins + 1] - x) / (e[bins + 1] - e[bins])
    out[np.arange(len(x)), bins], out[np.arange(len(x)), bins + 1] = left, 1 - left
    return out


def fit(x, y, wanted, numeric=(), categorical=(), kind="pointwise", level=0.95):
    """(x means, dots of this kind, lower, upper, se) with HC1 intervals at mean controls."""
    edges, bins = edges_and_bins(x, wanted)
    basis = design(x, edges, bins, kind)
    w = [np.asarray(c, float) for c in numeric]
    dummies = one_hot(categorical)
    w = np.stack(w, axis=1) if w else np.zeros((len(x), 0))
    if dummies is not None:
        w = np.hstack([w, dummies])
    a = np.hstack([basis, w])
    inv = np.linalg.pinv(a.T @ a, rcond=1e-13)
    theta = inv @ (a.T @ y)
    u = y - a @ theta
    rank = np.linalg.matrix_rank(a)
    cov = inv @ ((a * u[:, None] ** 2).T @ a) @ inv * len(x) / max(1, len(x) - rank)
    j = bins.max() + 1
    mx = np.array([x[bins == b].mean() for b in range(j)])
    at = np.hstack([design(mx, edges, np.arange(j), kind), np.tile(w.mean(axis=0), (j, 1))])
    center = at @ theta
    se = np.sqrt(np.einsum("ja,ab,jb->j", at, cov, at))
    z = NormalDist().inv_cdf((1 + level) / 2)
    return mx, center, center - z * se, center + z * se, se


def rot(x, y, numeric=(), categorical=()):
    n = len(x)
    cols = [np.ones(n), x, *numeric]
    dummies = one_hot(categorical)
    a = np.stack(cols, axis=1)
    if dummies is not None:
        a = np.hstack([a, dummies])
    theta = np.linalg.lstsq(a, y, rcond=None)[0]
    sigma2 = x.var()
    z2 = np.minimum((x - x.mean()) ** 2 / sigma2, 1.96**2)
    bias = theta[1] ** 2 * np.mean(np.exp(z2) * 2 * math.pi * sigma2) / 12
    variance = ((y - a @ theta) ** 2).mean()
    return min(max(2, n // 10), max(2, round((2 * bias / variance) ** (1 / 3) * n ** (1 / 3))))


def dpi(x, y, numeric=(), categorical=()):
    pilot = rot(x, y, numeric, categorical)
    edges, bins = edges_and_bins(x, pilot)
    j, n = bins.max() + 1, len(x)
    dummies = one_hot(categorical)
    w = [np.asarray(c, float) for c in numeric]
    w = np.stack(w, axis=1) if w else np.zeros((n, 0))
    if dummies is not None:
        w = np.hstack([w, dummies])
    a = np.hstack([design(x, edges, bins, "rbc"), w])
    theta = np.linalg.lstsq(a, y, rcond=None)[0]
    slope = np.diff(theta[: j + 1]) / np.diff(edges)
    mx = np.array([x[bins == b].mean() for b in range(j)])
    bias = np.mean((slope[bins] * (x - mx[bins])) ** 2) * j**2
    se = fit(x, y, pilot, numeric, categorical)[4]
    variance = (np.bincount(bins) * se**2).sum() / n / j
    return max(2, math.ceil((2 * bias / variance) ** (1 / 3)))
