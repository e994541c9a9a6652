import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterlake.operators import quantiles
from scatterlake.operators.dummies import one_hot
from scatterlake.operators.fixed_effects import Cells
from tests.dense import one_hot as dense_one_hot


@pytest.mark.parametrize("bins", [3, 10, 37, 200])
def test_two_phase_quantiles_equal_numpy(spark, bins, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_VALUES", 4000)
    monkeypatch.setattr(quantiles, "FEW_DISTINCT", 50)
    rng = np.random.default_rng(bins)
    for x in (rng.normal(size=20_000), np.round(rng.exponential(size=20_000), 2), rng.integers(0, 9, 20_000).astype(float),
              np.concatenate([np.zeros(9_000), rng.normal(size=9_000), np.full(2_000, 1e9)])):
        df = spark.createDataFrame(pd.DataFrame({"_x": x})).repartition(4)
        got = quantiles.exact_quantiles(df, "_x", bins, len(x))
        np.testing.assert_allclose(got, np.quantile(x, [i / bins for i in range(bins + 1)]), rtol=1e-9, atol=1e-9)  # numpy rounds the position
        assert set(got) & set(x)


def test_bins_are_left_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 3, 4)], "_x double")
    got = [r["_b"] for r in quantiles.assign(df, [1.0, 3.0]).collect()]
    assert got == [0, 1, 1, 1, 2, 2]
    many = [i / 10 for i in range(1, 40)]
    wide = [r["_b"] for r in quantiles.assign(df, many).collect()]
    assert wide == [sum(v >= e for e in many) for v in (0, 1, 1, 2, 3, 4)]


def topology(kind, rng, n=600):
    a = rng.integers(0, 12, n)
    return {
        "crossed": np.stack([a, rng.integers(0, 9, n)], 1),
        "disconnected": np.stack([a, (a // 6) * 10 + rng.integers(0, 5, n)], 1),
        "nested": np.stack([a, a // 3], 1),
        "duplicate": np.stack([a, a], 1),
        "one": a[:, None],
        "three": np.stack([a, rng.integers(0, 5, n), rng.integers(0, 4, n)], 1),
    }[kind]


@pytest.mark.parametrize("kind", ["crossed", "disconnected", "nested", "duplicate", "one", "three"])
@pytest.mark.parametrize("dense", [True, False])
def test_projection_and_rank(kind, dense, monkeypatch):
    from scatterlake.operators import fixed_effects

    if not dense:
        monkeypatch.setattr(fixed_effects, "DENSE_LEVELS", 0)
    rng = np.random.default_rng(4)
    rows = topology(kind, rng)
    v = rng.normal(size=(len(rows), 3))
    codes, cell = np.unique(rows, axis=0, return_inverse=True)
    cell = cell.ravel()
    cells = Cells(codes, np.bincount(cell))
    sums = np.stack([np.bincount(cell, v[:, k]) for k in range(3)], axis=1)
    fitted = cells.effects(cells.solve(cells.level_sums(sums)))[cell]
    d = np.hstack([np.ones((len(rows), 1)), dense_one_hot([rows[:, f] for f in range(rows.shape[1])])])
    want = d @ np.linalg.lstsq(d, v, rcond=None)[0]
    np.testing.assert_allclose(fitted, want, atol=2e-8)
    rank = np.linalg.matrix_rank(d)
    assert cells.rank() == rank if kind != "three" else cells.rank() >= rank


def test_long_chain_is_one_component():
    n = 3000
    codes = np.array([(i, i) for i in range(n)] + [(i + 1, i) for i in range(n - 1)])
    assert Cells(codes, np.ones(len(codes))).components() == 1


def test_one_hot_drops_the_first_level_and_constants(spark):
    df = spark.createDataFrame([("b", "k", 1), ("a", "k", 2), (None, "k", 3), ("c", "k", 4)], "g string, c string, `odd name` int")
    out, names = one_hot(df, ("g", "c"))
    assert len(names) == 2 and all(n.startswith("__ctrl_g_") and len(n) <= 64 for n in names)
    assert [[r[n] for n in names] for r in out.collect()] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 1.0]]


@settings(max_examples=12, deadline=None)
@given(st.integers(2, 6), st.integers(5, 12), st.integers(0, 10_000), st.floats(-5, 5), st.floats(0.1, 8))
def test_affine_equivariance_and_permutation(spark, bins, per, seed, shift, factor):
    from scatterlake import bin_plot

    rng = np.random.default_rng(seed)
    n = bins * per
    pdf = pd.DataFrame({"x": np.cumsum(rng.uniform(0.1, 1, n)), "y": rng.normal(size=n), "z": rng.normal(size=n)})
    run = lambda p: bin_plot(spark.createDataFrame(p), "x", "y", controls="z", num_bins=bins, return_type="native").toPandas()
    base = run(pdf)
    moved = run(pdf.assign(x=pdf.x * factor + shift, y=pdf.y * factor - shift).sample(frac=1, random_state=seed))
    np.testing.assert_allclose(moved.x, base.x * factor + shift, rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose(moved.y, base.y * factor - shift, rtol=1e-6, atol=1e-6)


def test_by_halving_equals_sorting(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=200), [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, 7.0, 7.0]])
    df = spark.createDataFrame(pd.DataFrame({"_x": x}))
    got = quantiles.by_halving(df, "_x", [0, 3, 50, 100, 101, 150, 206, 207])
    assert got == {r: float(np.sort(x)[r]) for r in got}
