import math

import numpy as np
import pandas as pd
import pytest

from scatterlake import bin_plot
from tests import dense


def panel(n=1500, seed=0, firms=25, years=8):
    rng = np.random.default_rng(seed)
    firm, year = rng.integers(0, firms, n), rng.integers(0, years, n)
    x = rng.normal(size=n) + firm / 20
    z = 0.5 * x + rng.normal(size=n)
    y = np.sin(x) + 0.4 * z + firm / 10 - year / 5 + rng.normal(size=n) * (0.3 + 0.2 * np.abs(x))
    return pd.DataFrame({"x": x, "y": y, "z": z, "firm": [f"f{v:03d}" for v in firm], "year": year, "__count": rng.normal(size=n)})


@pytest.fixture(scope="module")
def frames(spark):
    pdf = panel()
    return pdf, spark.createDataFrame(pdf).repartition(3).persist()


def native(df, *args, **kwargs):
    return bin_plot(df, *args, return_type="native", **kwargs).toPandas().sort_values("bin")


CASES = [
    ((), ()), (("z",), ()), (("z", "__count"), ()), ((), ("firm",)), (("z",), ("firm",)), (("z",), ("firm", "year")), ((), ("firm", "year")),
]


@pytest.mark.parametrize("numeric,categorical", CASES)
@pytest.mark.parametrize("kind", ["pointwise", "rbc"])
def test_dots_and_intervals_equal_dense_regression(frames, numeric, categorical, kind):
    pdf, df = frames
    got = native(df, "x", "y", controls=[*numeric, *categorical], num_bins=7, ci=kind, categorical=[c for c in categorical if c == "year"])
    args = (pdf.x.values, pdf.y.values, 7, [pdf[c].values for c in numeric], [pdf[c].values for c in categorical])
    mx, dots, *_ = dense.fit(*args)
    _, _, lower, upper, se = dense.fit(*args, kind=kind)
    assert got.columns.tolist() == ["bin", "x", "y", "ci_lower", "ci_upper", "ci_std_error"]
    np.testing.assert_allclose(got.x, mx, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got.y, dots, rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(got.ci_std_error, se, rtol=1e-7)
    np.testing.assert_allclose(got.ci_lower, lower, rtol=1e-7, atol=1e-8)
    np.testing.assert_allclose(got.ci_upper, upper, rtol=1e-7, atol=1e-8)


@pytest.mark.parametrize("numeric,categorical", CASES)
def test_selectors_equal_dense(frames, numeric, categorical):
    from scatterlake.operators.clean import clean
    from scatterlake.operators.selectors import direct_plug_in, rule_of_thumb
    from scatterlake.plans.options import check

    pdf, df = frames
    data = clean(df, check("x", "y", [*numeric, *categorical], categorical=[c for c in categorical if c == "year"]))
    args = (pdf.x.values, pdf.y.values, [pdf[c].values for c in numeric], [pdf[c].values for c in categorical])
    assert rule_of_thumb(data) == dense.rot(*args)
    assert direct_plug_in(data) == dense.dpi(*args)


@pytest.mark.parametrize("degree", [1, 2, 3])
@pytest.mark.parametrize("controls", [(), ("z",), ("z", "firm")])
def test_polynomial_overlay(frames, degree, controls):
    pdf, df = frames
    spec = bin_plot(df, "x", "y", controls=controls, num_bins=6, poly_line=degree)
    trace = spec["data"][-1]
    a = np.stack([pdf.x**p for p in range(degree + 1)] + ([pdf.z - pdf.z.mean()] if "z" in controls else []), axis=1)
    if "firm" in controls:
        d = dense.one_hot([pdf.firm.values])
        a = np.hstack([a, d - d.mean(axis=0)])
    theta = np.linalg.lstsq(a, pdf.y.values, rcond=None)[0]
    grid = np.linspace(pdf.x.min(), pdf.x.max(), 200)
    np.testing.assert_allclose(trace["x"], grid)
    np.testing.assert_allclose(trace["y"], sum(theta[p] * grid**p for p in range(degree + 1)), rtol=1e-7, atol=1e-7)
    assert trace["name"] == f"Polynomial fit (deg {degree})"


def test_large_offsets_and_units_change_nothing(spark):
    pdf = panel(600, 3)
    base = native(spark.createDataFrame(pdf), "x", "y", controls=["z"], num_bins=5, ci="rbc")
    moved = pdf.assign(x=pdf.x * 1e3 + 1e9, y=pdf.y - 1e9, z=pdf.z * 1e-6 + 1e3)
    got = native(spark.createDataFrame(moved), "x", "y", controls=["z"], num_bins=5, ci="rbc")
    np.testing.assert_allclose(got.y + 1e9, base.y, atol=1e-4)
    np.testing.assert_allclose(got.ci_std_error, base.ci_std_error, rtol=1e-4)


def test_ties_two_values_and_errors(spark):
    rng = np.random.default_rng(1)
    two = spark.createDataFrame(pd.DataFrame({"a": [0.0, 1.0] * 50, "b": rng.normal(size=100), "c": rng.normal(size=100)}))
    assert native(two, "a", "b", num_bins=10).bin.tolist() == [0, 1]
    assert len(native(two, "a", "b", controls="c", num_bins="rot")) == 2
    with pytest.raises(ValueError, match="bin edges"):
        native(two, "a", "b", num_bins=3, ci="rbc")
    flat = spark.createDataFrame(pd.DataFrame({"a": [1.0] * 50, "b": range(50)}))
    with pytest.raises(ValueError, match="at least 2 bins"):
        native(flat, "a", "b", num_bins=5)
    three = spark.createDataFrame(pd.DataFrame({"a": [0, 1, 2] * 33, "b": range(99)}))
    assert len(native(three, "a", "b", num_bins=9)) >= 2
    few = spark.createDataFrame(pd.DataFrame({"a": range(12), "b": range(12)}))
    assert native(few, "a", "b", num_bins=4).a.tolist() == [1.0, 4.0, 7.0, 10.0]


def test_bad_rows_are_dropped_and_the_culprit_is_named(spark):
    rows = [(float(i), float(i) * 2, "a" if i % 2 else "b") for i in range(20)]
    bad = [(math.nan, 1.0, "a"), (1.0, math.inf, "a"), (-math.inf, 1.0, "b"), (None, 1.0, "a"), (1.0, None, "a"), (1.0, 1.0, None)]
    schema = "x double, y double, g string"
    good = native(spark.createDataFrame(rows, schema), "x", "y", controls="g", num_bins=4)
    mixed = native(spark.createDataFrame(rows + bad, schema), "x", "y", controls="g", num_bins=4)
    pd.testing.assert_frame_equal(good, mixed)
    with pytest.raises(ValueError, match="y hold"):
        native(spark.createDataFrame([(1.0, None, "a"), (2.0, math.nan, "b")], schema), "x", "y", num_bins=2)
    with pytest.raises(ValueError):
        native(spark.createDataFrame([], schema), "x", "y", num_bins=2)


def test_validation(frames):
    _, df = frames
    for error, kwargs in [
        (ValueError, {"return_type": "x"}), (ValueError, {"num_bins": "10"}), (TypeError, {"num_bins": None}), (ValueError, {"num_bins": 1}),
        (ValueError, {"num_bins": True}), (TypeError, {"num_bins": 2.9}), (TypeError, {"num_bins": 3.0}), (TypeError, {"num_bins": np.int64(5)}),
        (TypeError, {"poly_line": "2"}), (ValueError, {"poly_line": 4}), (ValueError, {"ci": "x"}), (TypeError, {"ci": "rbc", "ci_level": True}),
        (ValueError, {"ci": "rbc", "ci_level": 1.0}), (ValueError, {"controls": 5}), (TypeError, {"controls": [5]}), (ValueError, {"controls": ["x"]}),
        (ValueError, {"controls": ["z", "z"]}), (ValueError, {"categorical": ["z"]}), (ValueError, {"controls": ["missing"]}),
        (TypeError, {"controls": ["z"], "categorical": ["z"]}), (TypeError, {"num_bins": 1.5}), (TypeError, {"num_bins": float("1.0000001")}),
        (ValueError, {"num_bins": 0.5}), (ValueError, {"return_type": "x", "num_bins": None}), (ValueError, {"categorical": ["firm"]}),
        (ValueError, {"controls": ["z"], "categorical": ["firm"]}), (ValueError, {"quantile_method": "guess"}),
    ]:
        with pytest.raises(error):
            bin_plot(df, "x", "y", **kwargs)
    with pytest.raises(TypeError):
        bin_plot(df, 1, "y")
    with pytest.raises(TypeError):
        bin_plot(df, "firm", "y")
    with pytest.raises(ValueError, match="reserved"):
        bin_plot(df, "bin", "y")
    with pytest.raises(TypeError, match="2 columns"):
        bin_plot(df.select("x"), "x", "y")
    with pytest.warns(UserWarning, match="IMSE-optimal"):
        bin_plot(df, "x", "y", num_bins="rot", ci="pointwise")
    with pytest.raises(ValueError, match="determined by the bins"):
        told = df.sparkSession.range(100).selectExpr("id x", "id * 2 + rand(1) y", "cast(id >= 50 as int) k")
        bin_plot(told, "x", "y", controls="k", num_bins=2)


def test_what_is_false_means_no_control():
    from scatterlake.plans.options import check

    for nothing in (None, (), [], "", 0, False, {}):
        assert check("x", "y", nothing).controls == ()
    assert check("x", "y", poly_line=True).poly_line == 1 and check("x", "y", (c for c in "ab")).controls == ("a", "b")


def test_figure(frames):
    pdf, df = frames
    with pytest.warns(UserWarning) as told:
        spec = bin_plot(df, "x", "y", num_bins=5, ci="pointwise", poly_line=2, size=12, range_x=[0, 1], opacity=0.5, labels={"x": "Age"}, color=list("aabbc"), title="T", width=300)
    said = [str(w.message) for w in told]
    assert any("range_x is set" in m for m in said) and any("given size" in m for m in said)
    assert spec["data"][0]["marker"] == {"size": 12, "color": list("aabbc"), "opacity": 0.5}
    assert spec["layout"]["title"]["text"] == "T" and spec["layout"]["width"] == 300 and spec["layout"]["xaxis"]["title"]["text"] == "Age"
    assert all(t["showlegend"] is False for t in spec["data"]) and spec["data"][1]["hoverinfo"] == "skip"
    with pytest.raises(TypeError):
        bin_plot(df, "x", "y", num_bins=5, no_such_keyword=1)
    spec = bin_plot(df, "x", "y", num_bins=5, ci="pointwise", poly_line=2)
    assert [t["name"] for t in spec["data"]] == ["", "Confidence interval", "Polynomial fit (deg 2)"]
    span = pdf.x.max() - pdf.x.min()
    np.testing.assert_allclose(spec["layout"]["xaxis"]["range"], [pdf.x.min() - 0.06872 * span, pdf.x.max() + 0.06872 * span])
    assert spec["layout"]["xaxis"]["title"]["text"] == "x" and spec["data"][0]["marker"] == {"size": 8, "color": "black"}


def test_sources_and_stream(spark, frames, tmp_path):
    from scatterlake.sources.frames import read
    from scatterlake.streaming.means import streaming_bin_means

    pdf, df = frames
    pd.testing.assert_frame_equal(native(pdf, "x", "y", num_bins=4), native(df, "x", "y", num_bins=4), rtol=1e-9)
    path = str(tmp_path / "t.csv")
    df.select("x", "y").coalesce(1).write.option("header", True).csv(path)
    assert read(spark, path, "csv").dtypes == [("x", "double"), ("y", "double")]
    assert read(spark, path, "csv", schema="x double, y double").count() == len(pdf)
    with pytest.raises(ValueError):
        read(spark, path, "avro2")
    parquet = str(tmp_path / "p")
    df.select("x", "y").write.parquet(parquet)
    edges, bins = dense.edges_and_bins(pdf.x.values, 4)
    stream = streaming_bin_means(spark.readStream.schema("x double, y double").parquet(parquet), "x", "y", edges)
    query = stream.writeStream.format("memory").queryName("means").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("means").toPandas().sort_values("bin")
    assert got.n.tolist() == np.bincount(bins).tolist()
    np.testing.assert_allclose(got.mean_y, [pdf.y[bins == b].mean() for b in range(4)])


def test_stream_bins_ties_as_a_batch_does(spark, tmp_path):
    from scatterlake.operators.quantiles import edges_of
    from scatterlake.streaming.means import streaming_bin_means

    for k, x in enumerate(([0.0] * 30 + [float(i) for i in range(1, 31)], [0.0, 1.0] * 25)):
        pdf = pd.DataFrame({"x": x, "y": np.arange(len(x), dtype=float)})
        path = str(tmp_path / f"t{k}")
        spark.createDataFrame(pdf).write.parquet(path)
        edges, _ = edges_of(np.quantile(pdf.x, [i / 5 for i in range(6)]).tolist())
        stream = streaming_bin_means(spark.readStream.schema("x double, y double").parquet(path), "x", "y", edges)
        query = stream.writeStream.format("memory").queryName(f"ties{k}").outputMode("complete").start()
        query.processAllAvailable()
        query.stop()
        got = spark.table(f"ties{k}").toPandas().sort_values("bin")
        batch = native(spark.createDataFrame(pdf), "x", "y", num_bins=5)
        assert got.bin.tolist() == batch.bin.tolist()
        np.testing.assert_allclose(got.mean_y, batch.y)


def test_a_control_that_the_bins_determine_within_firms_is_refused(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": np.arange(400.0), "firm": [f"f{v}" for v in rng.integers(0, 5, 400)], "year": rng.integers(0, 4, 400), "y": rng.normal(size=400)})
    pdf["told"] = (pdf.x >= 200).astype(float) + pdf.firm.str[1].astype(float) * 3
    for scale in (1.0, 1e-9):
        df = spark.createDataFrame(pdf.assign(told=pdf.told * scale))
        with pytest.raises(ValueError, match="determined by the bins"):
            bin_plot(df, "x", "y", controls=["told", "firm", "year"], categorical=["year"], num_bins=4)
    # a control that the firms determine is redundant, not arbitrary
    same = pdf.assign(told=pdf.firm.str[1].astype(float))
    a = native(spark.createDataFrame(same), "x", "y", controls=["told", "firm"], num_bins=4)
    b = native(spark.createDataFrame(same), "x", "y", controls=["firm"], num_bins=4)
    np.testing.assert_allclose(a.y, b.y, atol=1e-8)


@pytest.mark.parametrize("kind", ["pointwise", "rbc"])
def test_three_factors(spark, kind):
    pdf = panel(1200, 8)
    pdf["state"] = np.random.default_rng(2).integers(0, 6, len(pdf))
    df = spark.createDataFrame(pdf).repartition(3)
    got = native(df, "x", "y", controls=["z", "firm", "year", "state"], categorical=["year", "state"], num_bins=5, ci=kind, persist=False)
    args = (pdf.x.values, pdf.y.values, 5, [pdf.z.values], [pdf.firm.values, pdf.year.values, pdf.state.values])
    np.testing.assert_allclose(got.y, dense.fit(*args)[1], rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose(got.ci_std_error, dense.fit(*args, kind=kind)[4], rtol=1e-3)  # the rank of three factors is a bound


def test_nested_and_disconnected_designs_through_the_plug_in_and_intervals(spark):
    from scatterlake.operators.clean import clean
    from scatterlake.operators.selectors import direct_plug_in
    from scatterlake.plans.options import check

    pdf = panel(900, 5, firms=12)
    number = pdf.firm.str[1:].astype(int)
    for other in (number // 4, (number // 6) * 10 + pdf.year % 3):
        frame = pdf.assign(group=other)
        df = spark.createDataFrame(frame).repartition(2)
        data = clean(df, check("x", "y", ["firm", "group"], categorical=["group"]))
        columns = [frame.firm.values, frame.group.values]
        assert direct_plug_in(data) == dense.dpi(frame.x.values, frame.y.values, (), columns)
        got = native(df, "x", "y", controls=["firm", "group"], categorical=["group"], num_bins=4, ci="rbc")
        np.testing.assert_allclose(got.ci_std_error, dense.fit(frame.x.values, frame.y.values, 4, (), columns, kind="rbc")[4], rtol=1e-6)


def test_extreme_scales(spark):
    pdf = panel(500, 4)
    base = native(spark.createDataFrame(pdf), "x", "y", controls=["z"], num_bins=5)
    for sx, sy in ((1e200, 1e-170), (1e-170, 1e200)):
        got = native(spark.createDataFrame(pdf.assign(x=pdf.x * sx, y=pdf.y * sy, z=pdf.z * sx)), "x", "y", controls=["z"], num_bins=5)
        np.testing.assert_allclose(got.y / sy, base.y, rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(got.x / sx, base.x, rtol=1e-9, atol=1e-12)


def test_sums_per_combination_are_bounded_before_they_are_collected(spark, monkeypatch):
    from scatterlake.operators import fixed_effects

    monkeypatch.setattr(fixed_effects, "MAX_BYTES", 2000)
    with pytest.raises(ValueError, match="combinations of levels"):
        bin_plot(spark.createDataFrame(panel(300)), "x", "y", controls="firm", num_bins=4)


def test_many_levels(spark):
    rng = np.random.default_rng(6)
    n = 20_000
    pdf = pd.DataFrame({"x": rng.normal(size=n), "firm": rng.integers(0, 5000, n)})
    pdf["y"] = pdf.x + pdf.firm / 1000 + rng.normal(size=n)
    got = native(spark.createDataFrame(pdf), "x", "y", controls="firm", categorical="firm", num_bins=6)
    _, bins = dense.edges_and_bins(pdf.x.values, 6)
    ind = pd.DataFrame(np.eye(6)[bins])
    w, u = ind - ind.groupby(pdf.firm).transform("mean"), pdf.y - pdf.y.groupby(pdf.firm).transform("mean")
    theta = np.linalg.lstsq(w.values[:, 1:], u.values, rcond=None)[0]
    want = pdf.y.mean() - ind.values[:, 1:].mean(axis=0) @ theta + np.append(0, theta)
    np.testing.assert_allclose(got.y, want, rtol=1e-8)


def test_approximate_quantiles_are_near(frames):
    pdf, df = frames
    got = native(df, "x", "y", num_bins=6, quantile_method="approx")
    exact = native(df, "x", "y", num_bins=6)
    assert len(got) == 6 and np.abs(got.x - exact.x).max() < 0.3


def test_a_changed_second_pass_is_noticed(spark):
    from scatterlake.operators.clean import clean
    from scatterlake.operators.fit import fit_bins, indicator_basis
    from scatterlake.operators.intervals import std_errors
    from scatterlake.operators.moments import bin_moments
    from scatterlake.operators.quantiles import assign
    from scatterlake.plans.options import check
    from pyspark.sql import functions as F

    data = clean(spark.createDataFrame(panel(400)), check("x", "y", ["firm"]))
    data = data.binned(assign(data.df, [0.0, 0.7]))
    m = bin_moments(data, F.col("_b"), 3)
    changed = data.binned(data.df.withColumn("_g0", F.when(F.col("_g0") == "f003", "new").otherwise(F.col("_g0"))))
    with pytest.raises(ValueError, match="two passes"):
        std_errors(changed, F.col("_b"), fit_bins(m, indicator_basis(3)), m)
