"""Registered queries of the engine, and the same results in plain SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean, valid_rows
from ..operators.components import level_components
from ..operators.dummies import dummy_name, one_hot
from ..operators.fit import fit_polynomial
from ..operators.fixed_effects import crosstab
from ..operators.moments import gram
from ..operators.quantiles import assign, edges_of, exact_quantiles, interior_edges
from ..operators.selectors import direct_plug_in, rule_of_thumb
from ..sources.frames import read
from .api import bin_plot
from .figure import axis_range
from .options import check

Query = Callable[[SparkSession, str], DataFrame]
PRICE, QTY = "l_extendedprice", "l_quantity"
SIGNAL = "CAST(l_extendedprice * (1 - l_discount) + 2000 * l_quantity AS DOUBLE)"
#: So noisy that both selectors choose few bins (five for the pilot at sf0.01), which SQL can solve for.
NOISY = "CAST(40 * l_discount + 0.00000067 * l_extendedprice AS DOUBLE)"
SHIP_YEAR, YEAR_0, YEAR_1 = "CAST(year(l_shipdate) AS INT)", 1995, 2001
BAD = (
    "CASE WHEN l_orderkey % 50 = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 50 = 2 THEN CAST('Infinity' AS DOUBLE) "
    "WHEN l_orderkey % 50 = 3 THEN NULL ELSE l_extendedprice END"
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _frame(spark: SparkSession, sf_dir: str, table: str, **derived: str) -> DataFrame:
    df = _table(spark, sf_dir, table)
    return df.selectExpr("*", *[f"{e} AS {c}" for c, e in derived.items()])


def _scatter(table: str, x: str, y: str, derived: dict | None = None, **kwargs) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(bin_plot(_frame(spark, sf_dir, table, **(derived or {})), x, y, return_type="native", **kwargs))

    return query


def _data(spark, sf_dir, table, x, y, controls=(), categorical=None, **derived):
    return clean(_frame(spark, sf_dir, table, **derived), check(x, y, controls, categorical=categorical), persist=False)


def _one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))


def _edges(data, bins):
    edges, made = edges_of(exact_quantiles(data.df, "_x", bins, data.n, data.distinct))
    return edges, made, assign(data.df, interior_edges(edges, data.low, data.high)).withColumnRenamed("_b", "bin")


def bin_edges(spark, sf_dir):
    edges, *_ = _edges(_data(spark, sf_dir, "lineitem", PRICE, QTY), 10)
    return _rounded(spark.createDataFrame(list(enumerate(edges)), "i int, edge double"))


def bin_counts(spark, sf_dir):
    data = _data(spark, sf_dir, "lineitem", PRICE, QTY)
    return _edges(data, 10)[2].groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def two_valued(spark, sf_dir):
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id")
    return _rounded(bin_plot(both, "quality", "n_chars", num_bins=10, return_type="native"))


def clean_rows(spark, sf_dir):
    df = _frame(spark, sf_dir, "lineitem", bad=BAD)
    rows, *_ = valid_rows(df, check("bad", QTY, ["l_returnflag"]))
    return rows.groupBy(F.col("_g0").alias("l_returnflag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_x"), 2).alias("sum_x"))


#: Rows' means of products of 1, x (price), z (discount) and y (quantity), and digits that all sums agree on.
MOMENTS = {"1x": 3, "1z": 8, "1y": 7, "xx": 0, "xz": 3, "xy": 2, "zz": 8, "zy": 7, "yy": 6}


def global_moments(spark, sf_dir):
    data = _data(spark, sf_dir, "lineitem", PRICE, QTY, ["l_discount"])
    n, g = gram(data.df, [F.col("_x"), F.col("_w0")], F.col("_y"))
    names = "1xzy"
    return _one_row(spark, n=n, **{f"m_{k}": round(float(g[names.index(k[0]), names.index(k[1])]) / n, digits) for k, digits in MOMENTS.items()})


def _selector(choose, controls=(), categorical=None, signal=SIGNAL) -> Query:
    def query(spark, sf_dir):
        return _one_row(spark, bins=choose(_data(spark, sf_dir, "lineitem", PRICE, "signal", controls, categorical, signal=signal)))

    return query


def fe_cells(spark, sf_dir):
    return crosstab(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


def fe_bin_crosstab(spark, sf_dir):
    data = _data(spark, sf_dir, "lineitem", PRICE, QTY, ["l_returnflag", "l_linestatus"])
    rows = _edges(data, 5)[2]
    names = dict(zip(data.groups, data.categorical, strict=True))
    return crosstab(rows, list(data.groups), "bin").withColumnsRenamed(names)


def fe_cardinality_order(spark, sf_dir):
    data = _data(spark, sf_dir, "lineitem", PRICE, QTY, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], ["l_linenumber", "l_suppkey"])
    return spark.createDataFrame(list(enumerate(data.categorical)), "place int, control string")


def fe_components(spark, sf_dir):
    data = _data(spark, sf_dir, "lineitem", PRICE, QTY, ["l_suppkey", "l_orderkey"], ["l_suppkey", "l_orderkey"])
    components, levels = level_components(data.df, data.groups, data.n)
    return _one_row(spark, components=components, rank=levels - components * (len(data.groups) - 1))


def _poly(degree: int) -> Query:
    def query(spark, sf_dir):
        curve = fit_polynomial(_data(spark, sf_dir, "lineitem", PRICE, "signal", signal=SIGNAL), degree)
        return _rounded(spark.createDataFrame(list(zip(range(len(curve.grid_x)), curve.grid_x, curve.grid_y, strict=True)), "i int, x double, y double"), 4)

    return query


def dummies(spark, sf_dir):
    df, added = one_hot(_table(spark, sf_dir, "lineitem"), ("l_returnflag",))
    return df.agg(*[F.sum(c).alias(f"sum_{i}") for i, c in enumerate(added)], F.count(F.lit(1)).alias("n"))


def dummy_names(spark, sf_dir):
    table = _table(spark, sf_dir, "lineitem")
    levels = sorted(r["l_returnflag"] for r in table.select("l_returnflag").distinct().collect())[1:]
    added = one_hot(table, ("l_returnflag",))[1]
    assert list(added) == [dummy_name("l_returnflag", v) for v in levels]
    return spark.createDataFrame(list(zip(levels, added, strict=True)), "level string, name string")


def figure_ranges(spark, sf_dir):
    row = _table(spark, sf_dir, "orders").agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    spec = bin_plot(_table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", num_bins=10)
    low, high = (spec["layout"]["xaxis"]["range"] if isinstance(spec, dict) else spec.layout.xaxis.range)
    assert [low, high] == axis_range(*row)
    return _rounded(_one_row(spark, low=float(low), high=float(high)))


DISCOUNT = ["l_discount"]
QUERIES: dict[str, Query] = {
    "bin_means": _scatter("lineitem", PRICE, QTY, num_bins=10),
    "bin_means_20": _scatter("orders", "o_totalprice", "o_custkey", num_bins=20),
    "bin_means_dedup": _scatter("lineitem", "l_discount", QTY, num_bins=20),
    "bin_means_dirty": _scatter("lineitem", "bad", QTY, {"bad": BAD}, num_bins=7),
    "bin_two_valued": two_valued,
    "bin_edges": bin_edges,
    "bin_counts": bin_counts,
    "clean_rows": clean_rows,
    "global_moments": global_moments,
    "rot_bins": _selector(rule_of_thumb),
    "rot_control_bins": _selector(rule_of_thumb, ["l_tax"]),
    "rot_fe_bins": _selector(rule_of_thumb, ["l_suppkey"], ["l_suppkey"]),
    "dpi_bins": _selector(direct_plug_in, signal=NOISY),
    "dpi_control_fe_bins": _selector(direct_plug_in, ["l_tax", "l_returnflag"], signal=NOISY),
    "plot_rot": _scatter("lineitem", PRICE, "signal", {"signal": SIGNAL}, num_bins="rule-of-thumb"),
    "plot_dpi": _scatter("lineitem", PRICE, "signal", {"signal": NOISY}),
    "adjust_one_control": _scatter("lineitem", PRICE, QTY, controls=DISCOUNT, num_bins=10),
    "adjust_two_controls": _scatter("lineitem", PRICE, QTY, controls=["l_discount", "l_tax"], num_bins=10),
    "adjust_categorical_3level": _scatter("lineitem", PRICE, QTY, controls="l_returnflag", num_bins=10),
    "adjust_int_categorical": _scatter("lineitem", PRICE, QTY, controls="l_linenumber", categorical="l_linenumber", num_bins=10),
    "adjust_fe_100_levels": _scatter("lineitem", PRICE, QTY, controls="l_suppkey", categorical="l_suppkey", num_bins=10),
    "adjust_two_way_fe": _scatter("lineitem", PRICE, QTY, controls=["l_returnflag", "l_linenumber"], categorical="l_linenumber", num_bins=10),
    "adjust_three_way_fe": _scatter("lineitem", PRICE, QTY, controls=["l_linenumber", "l_returnflag", "l_shipyear", "l_tax"],
                                    categorical=["l_linenumber", "l_shipyear"], num_bins=10, derived={"l_shipyear": SHIP_YEAR}),
    "fe_cells": fe_cells,
    "fe_bin_crosstab": fe_bin_crosstab,
    "fe_cardinality_order": fe_cardinality_order,
    "fe_components": fe_components,
    "ci_pointwise": _scatter("lineitem", PRICE, QTY, num_bins=10, ci="pointwise"),
    "ci_pointwise_control": _scatter("lineitem", PRICE, QTY, controls=DISCOUNT, num_bins=10, ci="pointwise", ci_level=0.9),
    "ci_rbc": _scatter("lineitem", PRICE, QTY, num_bins=10, ci="rbc"),
    "ci_rbc_two_way_fe": _scatter(
        "lineitem", PRICE, QTY, controls=["l_linenumber", "l_returnflag", "l_tax"], categorical="l_linenumber", num_bins=5, ci="rbc"
    ),
    "ci_pointwise_fe": _scatter("lineitem", PRICE, QTY, controls=["l_returnflag", "l_tax"], num_bins=5, ci="pointwise"),
    "poly_line_1": _poly(1),
    "poly_line_2": _poly(2),
    "poly_line_3": _poly(3),
    "one_hot": dummies,
    "one_hot_names": dummy_names,
    "figure_ranges": figure_ranges,
}


def _binned(table: str, x: str, y: str, bins: int, extra: str = "") -> str:
    """CTEs d (rows), q (edges e), b (rows with bin): left-closed bins on distinct type-7 quantiles."""
    probs = [i / bins for i in range(bins + 1)]
    return f"""
d0 AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y{extra} FROM {table}),
d AS (SELECT * FROM d0 WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y)),
q AS (SELECT list_sort(list_distinct(quantile_cont(x, {probs}))) AS e FROM d),
b AS (SELECT d.*, CAST(len(list_filter(CASE WHEN len(e) = 2 THEN e[2:2] ELSE e[2:len(e)-1] END, lambda v: x >= v)) AS INTEGER) AS bin FROM d, q)"""


def _means(table: str, x: str, y: str, bins: int, name_x: str, name_y: str) -> str:
    return f"WITH {_binned(table, x, y, bins)} SELECT bin, ROUND(AVG(x), 7) AS {name_x}, ROUND(AVG(y), 7) AS {name_y} FROM b GROUP BY bin"


def _inverse(k: int, source: str, tag: str = "") -> str:
    """CTEs that invert the k x k matrix in columns a_i_j of a one-row CTE; the result is inv (v_i_j), with ``tag`` before all names."""
    cols = [(i, j) for i in range(k) for j in range(2 * k)]
    first = ", ".join(f"CAST({f'a_{i}_{j}' if j < k else int(j - k == i)} AS DOUBLE) AS g_{i}_{j}" for i, j in cols)
    out = [f"{tag}gauss0 AS (SELECT {first} FROM {source})"]
    for p in range(k):
        row = {j: f"g_{p}_{j} / g_{p}_{p}" for j in range(2 * k)}
        out.append(f"{tag}gauss{p + 1} AS (SELECT " + ", ".join(
            f"{row[j]} AS g_{i}_{j}" if i == p else f"g_{i}_{j} - g_{i}_{p} * ({row[j]}) AS g_{i}_{j}" for i, j in cols) + f" FROM {tag}gauss{p})")
    out.append(f"{tag}inv AS (SELECT " + ", ".join(f"g_{i}_{k + j} AS v_{i}_{j}" for i in range(k) for j in range(k)) + f" FROM {tag}gauss{k})")
    return ",\n".join(out)


def _rot_sql(columns: list[str], within: str | None = None, signal: str = SIGNAL) -> str:
    """Rule of thumb: a least-squares fit of y on standardised x and controls, within groups if any."""
    k = len(columns) + 1
    names = ["x", *columns]
    std = ", ".join(f"(x{i} - AVG(x{i}) OVER ()) / STDDEV_POP(x{i}) OVER () AS z{i}" for i in range(k))
    group = f"PARTITION BY {within}" if within else ""
    keep = f", {within}" if within else ""
    demeaned = ", ".join(f"z{i} - AVG(z{i}) OVER ({group}) AS w{i}" for i in range(k))
    matrix = ", ".join(f"SUM(w{i} * w{j}) AS a_{i}_{j}" for i in range(k) for j in range(k))
    right = ", ".join(f"SUM(w{i} * u) AS r_{i}" for i in range(k))
    theta = ", ".join("(" + " + ".join(f"v_{i}_{j} * r_{j}" for j in range(k)) + f") AS t_{i}" for i in range(k))
    fitted = " - ".join(f"t_{i} * r_{i}" for i in range(k))
    return f"""WITH d AS (SELECT {", ".join(f"CAST({c if c != "x" else PRICE} AS DOUBLE) AS x{i}" for i, c in enumerate(names))}, {signal} AS y{keep} FROM lineitem),
s AS (SELECT {std}, (y - AVG(y) OVER ()) / STDDEV_POP(y) OVER () AS s{keep} FROM d),
w AS (SELECT z0, {demeaned}, s - AVG(s) OVER ({group}) AS u FROM s),
m AS (SELECT COUNT(*) AS n, {matrix}, {right}, SUM(u * u) AS uu, SUM(exp(least(z0 * z0, 1.96 * 1.96)) * 2 * pi()) AS dens FROM w),
{_inverse(k, "m")},
t AS (SELECT n, uu, dens, {right and ", ".join(f"r_{i}" for i in range(k))}, {theta} FROM m, inv)
SELECT CAST(least(greatest(2, n // 10), greatest(2, round_even(pow(2 * (t_0 * t_0 * dens / n / 12) / ((uu - {fitted}) / n), 1.0 / 3) * pow(n, 1.0 / 3), 0))) AS BIGINT) AS bins FROM t"""


def _adjusted(table: str, x: str, y: str, bins: int, controls: list[str]) -> str:
    """Per-bin means plus within-bin slopes times the distance of the bin's controls from the overall means."""
    k = len(controls)
    extra = "".join(f", CAST({c} AS DOUBLE) AS z{i}" for i, c in enumerate(controls))
    w = ", ".join(f"z{i} - AVG(z{i}) OVER (PARTITION BY bin) AS w{i}" for i in range(k))
    matrix = ", ".join(f"SUM(w{i} * w{j}) AS a_{i}_{j}" for i in range(k) for j in range(k))
    right = ", ".join(f"SUM(w{i} * u) AS r_{i}" for i in range(k))
    theta = ", ".join("(" + " + ".join(f"v_{i}_{j} * r_{j}" for j in range(k)) + f") AS t_{i}" for i in range(k))
    means = ", ".join(f"AVG(z{i}) AS z{i}" for i in range(k))
    shift = " + ".join(f"t_{i} * (o.z{i} - p.z{i})" for i in range(k))
    return f"""WITH {_binned(table, x, y, bins, extra)},
w AS (SELECT {w}, y - AVG(y) OVER (PARTITION BY bin) AS u FROM b),
m AS (SELECT {matrix}, {right} FROM w),
{_inverse(k, "m")},
t AS (SELECT {theta} FROM m, inv),
p AS (SELECT bin, AVG(x) AS x, AVG(y) AS y, {means} FROM b GROUP BY bin),
o AS (SELECT {means} FROM b)
SELECT bin, ROUND(p.x, 7) AS {PRICE}, ROUND(p.y + {shift}, 7) AS {QTY} FROM p, o, t"""


def _absorbed(group: str, bins: int) -> str:
    """Few bins and one absorbed control of any size: bin indicators but the first, within groups."""
    k = bins - 1
    ind = ", ".join(f"CAST(bin = {i + 1} AS INT) - AVG(CAST(bin = {i + 1} AS INT)) OVER (PARTITION BY g) AS w{i}" for i in range(k))
    matrix = ", ".join(f"SUM(w{i} * w{j}) AS a_{i}_{j}" for i in range(k) for j in range(k))
    right = ", ".join(f"SUM(w{i} * u) AS r_{i}" for i in range(k))
    theta = ", ".join("(" + " + ".join(f"v_{i}_{j} * r_{j}" for j in range(k)) + f") AS t_{i}" for i in range(k))
    share = ", ".join(f"AVG(CAST(bin = {i + 1} AS INT)) AS p_{i}" for i in range(k))
    level = " - ".join(["o.y", *[f"t_{i} * p_{i}" for i in range(k)]])
    own = "CASE p.bin WHEN 0 THEN 0.0 " + " ".join(f"WHEN {i + 1} THEN t_{i}" for i in range(k)) + " END"
    return f"""WITH {_binned("lineitem", PRICE, QTY, bins, f", {group} AS g")},
w AS (SELECT {ind}, y - AVG(y) OVER (PARTITION BY g) AS u FROM b),
m AS (SELECT {matrix}, {right} FROM w),
{_inverse(k, "m")},
t AS (SELECT {theta} FROM m, inv),
p AS (SELECT bin, AVG(x) AS x FROM b GROUP BY bin),
o AS (SELECT AVG(y) AS y, {share} FROM b)
SELECT p.bin, ROUND(p.x, 7) AS {PRICE}, ROUND({level} + {own}, 7) AS {QTY} FROM p, o, t"""


def _interval(center: str, se: str, z: float) -> str:
    return f"ROUND({center} - {z!r} * {se}, 7) AS ci_lower, ROUND({center} + {z!r} * {se}, 7) AS ci_upper, ROUND({se}, 7) AS ci_std_error"


Z95, Z90 = 1.9599639845400536, 1.6448536269514715  # fixed values: normal quantiles of 0.975 and 0.95


def _robust(kind: str, bins: int, controls: int, tag: str) -> str:
    """CTEs of a fit on bin indicators or hat functions and centred controls z0.., with its sandwich.

    From b (bin, x, y, z..) and q (edges e); the last ones are t (n, t_i) and f (bin, n, x, y, mid, se), with ``tag`` before all names.
    """
    size = bins + (kind == "rbc")
    k = size + controls
    basis = []
    for i in range(size):
        if kind == "rbc":
            up = f"WHEN bin = {i - 1} THEN (x - e[{i}]) / (e[{i + 1}] - e[{i}]) " if i else ""
            down = f"WHEN bin = {i} THEN (e[{i + 2}] - x) / (e[{i + 2}] - e[{i + 1}]) " if i < bins else ""
            basis.append(f"CASE {up}{down}ELSE 0.0 END AS h{i}")
        else:
            basis.append(f"CAST(bin = {i} AS INT) AS h{i}")
    rows = ", ".join(basis + [f"z{i} - AVG(z{i}) OVER () AS h{size + i}" for i in range(controls)])
    points = ", ".join(basis)
    matrix = ", ".join(f"SUM(h{i} * h{j}) AS a_{i}_{j}" for i in range(k) for j in range(k))
    right = ", ".join(f"SUM(h{i} * y) AS r_{i}" for i in range(k))
    theta = ", ".join("(" + " + ".join(f"v_{i}_{j} * r_{j}" for j in range(k)) + f") AS t_{i}" for i in range(k))
    residual = "y - (" + " + ".join(f"t_{i} * h{i}" for i in range(k)) + ")"
    meat = ", ".join(f"SUM(u * u * h{i} * h{j}) AS c_{i}_{j}" for i in range(k) for j in range(k))
    lead = ", ".join("(" + " + ".join(f"v_{i}_{j} * h{j}" for j in range(size)) + f") AS l_{i}" for i in range(k))
    quad = " + ".join(f"l_{i} * c_{i}_{j} * l_{j}" for i in range(k) for j in range(k))
    center = " + ".join(f"t_{i} * h{i}" for i in range(size))
    return f"""{tag}h AS (SELECT bin, x, y, {rows} FROM b, q),
{tag}m AS (SELECT COUNT(*) AS n, {matrix}, {right} FROM {tag}h),
{_inverse(k, f"{tag}m", tag)},
{tag}t AS (SELECT n, {theta} FROM {tag}m, {tag}inv),
{tag}r AS (SELECT h.*, {residual} AS u FROM {tag}h AS h, {tag}t),
{tag}c AS (SELECT {meat} FROM {tag}r),
{tag}pm AS (SELECT bin, COUNT(*) AS n_bin, AVG(x) AS x, AVG(y) AS y FROM b GROUP BY bin),
{tag}p AS (SELECT bin, n_bin, x, y, {points} FROM {tag}pm, q),
{tag}l AS (SELECT p.*, {lead} FROM {tag}p AS p, {tag}inv),
{tag}f AS (SELECT bin, n_bin, x, y, {center} AS mid, sqrt(({quad}) * n / (n - {k})) AS se FROM {tag}l, {tag}c, {tag}t)"""


def _controlled(controls: list[str]) -> str:
    return "".join(f", CAST({c} AS DOUBLE) AS z{i}" for i, c in enumerate(controls))


def _interval_sql(kind: str, bins: int, controls: list[str]) -> str:
    """Dots of the indicator fit, intervals of the given kind."""
    dots = _robust("pointwise", bins, len(controls), "d")
    other = ",\n" + _robust("rbc", bins, len(controls), "r") if kind == "rbc" else ""
    ci = "r" if kind == "rbc" else "d"
    return f"""WITH {_binned("lineitem", PRICE, QTY, bins, _controlled(controls))},
{dots}{other}
SELECT df.bin, ROUND(df.x, 7) AS {PRICE}, ROUND(df.mid, 7) AS {QTY}, {_interval("i.mid", "i.se", Z95)} FROM df JOIN {ci}f AS i ON df.bin = i.bin"""


def _dpi_sql(bins: int, columns: list[str], dummies: list[str], within: str | None = None) -> str:
    """Direct plug-in at a pilot of ``bins``; no row where the rule of thumb gives another number."""
    controls = [*columns, *dummies]
    slope = " ".join(f"WHEN {i} THEN (t_{i + 1} - t_{i}) / (e[{i + 2}] - e[{i + 1}])" for i in range(bins))
    return f"""WITH rot AS ({_rot_sql(columns, within, NOISY)}),
{_binned("lineitem", PRICE, NOISY, bins, _controlled(controls))},
{_robust("pointwise", bins, len(controls), "d")},
{_robust("rbc", bins, len(controls), "r")},
s AS (SELECT bin, CASE bin {slope} END AS slope FROM df, rt, q),
v AS (SELECT b.bin, SUM((b.x - df.x) * (b.x - df.x)) AS xx FROM b JOIN df ON b.bin = df.bin GROUP BY b.bin),
k AS (SELECT SUM(slope * slope * xx) / ANY_VALUE(n) * {bins * bins} AS bias, SUM(n_bin * se * se) / ANY_VALUE(n) / {bins} AS variance
  FROM df JOIN s ON df.bin = s.bin JOIN v ON df.bin = v.bin, dt)
SELECT CAST(greatest(2, ceil(pow(2 * bias / variance, 1.0 / 3))) AS BIGINT) AS bins FROM k, rot WHERE rot.bins = {bins}"""


def _chosen_sql(choice: str, signal: str) -> str:
    """Bin means at a number of bins that a query chooses."""
    return f"""WITH j AS (SELECT bins FROM ({choice}) AS chosen),
d AS (SELECT CAST({PRICE} AS DOUBLE) AS x, {signal} AS y FROM lineitem),
s AS (SELECT list(x ORDER BY x) AS l, COUNT(*) AS n FROM d),
p AS (SELECT i, (i * (n - 1)) // bins AS q, (i * (n - 1)) % bins AS rest, bins, l FROM s, j, range(10000) AS v(i) WHERE i <= bins),
e AS (SELECT list_sort(list_distinct(list(CASE WHEN rest = 0 THEN l[q + 1] ELSE l[q + 1] + (l[q + 2] - l[q + 1]) * (CAST(rest AS DOUBLE) / bins) END))) AS e FROM p),
b AS (SELECT x, y, CAST(len(list_filter(e[2:len(e)-1], lambda v: x >= v)) AS INTEGER) AS bin FROM d, e)
SELECT bin, ROUND(AVG(x), 7) AS {PRICE}, ROUND(AVG(y), 7) AS signal FROM b GROUP BY bin"""


def _poly_sql(degree: int) -> str:
    k = degree + 1
    power = lambda v, p: " * ".join([v] * p) if p else "1.0"
    matrix = ", ".join(f"SUM({power('z', i + j)}) AS a_{i}_{j}" for i in range(k) for j in range(k))
    right = ", ".join(f"SUM({power('z', i)} * y) AS r_{i}" for i in range(k))
    theta = ", ".join("(" + " + ".join(f"v_{i}_{j} * r_{j}" for j in range(k)) + f") AS t_{i}" for i in range(k))
    value = " + ".join(f"t_{i} * {power('z', i)}" for i in range(k))
    return f"""WITH d AS (SELECT CAST({PRICE} AS DOUBLE) AS x, {SIGNAL} AS y FROM lineitem),
s AS (SELECT AVG(x) AS mx, STDDEV_POP(x) AS sx, MIN(x) AS lo, MAX(x) AS hi FROM d),
z AS (SELECT (x - mx) / sx AS z, y FROM d, s),
m AS (SELECT {matrix}, {right} FROM z),
{_inverse(k, "m")},
t AS (SELECT {theta} FROM m, inv),
g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 199 AS x, (lo + i * (hi - lo) / 199 - mx) / sx AS z FROM s, range(200) AS v(i))
SELECT i, ROUND(x, 4) AS x, ROUND({value}, 4) AS y FROM g, t"""


EDGE_SQL = f"WITH {_binned('lineitem', PRICE, QTY, 10)}"
POINTWISE_SQL = f"""WITH {_binned("lineitem", PRICE, QTY, 10)},
p AS (SELECT bin, COUNT(*) AS n, AVG(x) AS x, AVG(y) AS y FROM b GROUP BY bin),
v AS (SELECT b.bin, SUM((b.y - p.y) * (b.y - p.y)) AS uu FROM b JOIN p ON b.bin = p.bin GROUP BY b.bin),
t AS (SELECT SUM(n) AS total FROM p),
f AS (SELECT p.bin, p.x, p.y, sqrt(uu / (p.n * p.n) * total / (total - 10)) AS se FROM p JOIN v ON p.bin = v.bin, t)
SELECT bin, ROUND(x, 7) AS {PRICE}, ROUND(y, 7) AS {QTY}, {_interval("y", "se", Z95)} FROM f"""
POINTWISE_CONTROL_SQL = f"""WITH {_binned("lineitem", PRICE, QTY, 10, ", CAST(l_discount AS DOUBLE) AS z")},
p AS (SELECT bin, COUNT(*) AS n, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM b GROUP BY bin),
o AS (SELECT COUNT(*) AS n, AVG(z) AS z FROM b),
w AS (SELECT b.bin, b.z - p.z AS w, b.y - p.y AS u FROM b JOIN p ON b.bin = p.bin),
g AS (SELECT SUM(w * u) / SUM(w * w) AS g, SUM(w * w) AS s FROM w),
r AS (SELECT bin, w, u - g * w AS e FROM w, g),
a AS (SELECT SUM(e * e * w * w) AS all_ww FROM r),
c AS (SELECT bin, SUM(e * e) AS ee, SUM(e * e * w) AS ew FROM r GROUP BY bin),
f AS (SELECT p.bin, p.x, p.y + g * (o.z - p.z) AS mid,
  sqrt(o.n / (o.n - 11.0) * (ee / (p.n * p.n) + 2 * (o.z - p.z) / s * ew / p.n + (o.z - p.z) * (o.z - p.z) / (s * s) * all_ww)) AS se
  FROM p JOIN c ON p.bin = c.bin, o, g, a)
SELECT bin, ROUND(x, 7) AS {PRICE}, ROUND(mid, 7) AS {QTY}, {_interval("mid", "se", Z90)} FROM f"""
_ROT = _rot_sql([])
LINES = [f"(l_linenumber = {i})" for i in range(2, 8)]
FLAGS = ["(l_returnflag = 'N')", "(l_returnflag = 'R')"]
YEARS = [f"({SHIP_YEAR} = {i})" for i in range(YEAR_0 + 1, YEAR_1 + 1)]
PILOT = 5

ORACLE_SQL: dict[str, str] = {
    "bin_means": _means("lineitem", PRICE, QTY, 10, PRICE, QTY),
    "bin_means_20": _means("orders", "o_totalprice", "o_custkey", 20, "o_totalprice", "o_custkey"),
    "bin_means_dedup": _means("lineitem", "l_discount", QTY, 20, "l_discount", QTY),
    "bin_means_dirty": _means("lineitem", BAD, QTY, 7, "bad", QTY),
    "bin_two_valued": _means("labels JOIN documents USING (doc_id)", "quality", "n_chars", 10, "quality", "n_chars"),
    "bin_edges": f"{EDGE_SQL} SELECT CAST(i - 1 AS INTEGER) AS i, ROUND(e[i], 7) AS edge FROM q, range(1, 12) AS v(i) WHERE i <= len(e)",
    "bin_counts": f"{EDGE_SQL} SELECT bin, COUNT(*) AS n FROM b GROUP BY bin",
    "clean_rows": f"""WITH {_binned("lineitem", BAD, QTY, 2, ", l_returnflag")}
SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(x), 2) AS sum_x FROM d GROUP BY l_returnflag""",
    "global_moments": "SELECT COUNT(*) AS n, " + ", ".join(
        f"ROUND(AVG({' * '.join('1xzy'.index(c) and (PRICE, 'l_discount', QTY)['xzy'.index(c)] or '1.0' for c in k)}), {digits}) AS m_{k}"
        for k, digits in MOMENTS.items()) + " FROM lineitem",
    "rot_bins": _ROT,
    "rot_control_bins": _rot_sql(["l_tax"]),
    "rot_fe_bins": _rot_sql([], "l_suppkey"),
    "dpi_bins": _dpi_sql(PILOT, [], []),
    "dpi_control_fe_bins": _dpi_sql(PILOT, ["l_tax"], FLAGS, "l_returnflag"),
    "plot_rot": _chosen_sql(_ROT, SIGNAL),
    "plot_dpi": _chosen_sql(_dpi_sql(PILOT, [], []), NOISY),
    "adjust_one_control": _adjusted("lineitem", PRICE, QTY, 10, ["l_discount"]),
    "adjust_two_controls": _adjusted("lineitem", PRICE, QTY, 10, ["l_discount", "l_tax"]),
    "adjust_categorical_3level": _adjusted("lineitem", PRICE, QTY, 10, ["(l_returnflag = 'N')", "(l_returnflag = 'R')"]),
    "adjust_int_categorical": _absorbed("l_linenumber", 10),
    "adjust_fe_100_levels": _absorbed("l_suppkey", 10),
    "adjust_two_way_fe": _adjusted("lineitem", PRICE, QTY, 10, [*LINES, *FLAGS]),
    "adjust_three_way_fe": _adjusted("lineitem", PRICE, QTY, 10, [*LINES, *FLAGS, *YEARS, "l_tax"]),
    "fe_cells": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ALL",
    "fe_bin_crosstab": f"""WITH {_binned("lineitem", PRICE, QTY, 5, ", l_returnflag, l_linestatus")}
SELECT l_returnflag, l_linestatus, bin, COUNT(*) AS n FROM b GROUP BY ALL""",
    "fe_cardinality_order": """WITH c AS (SELECT 'l_returnflag' AS control, COUNT(DISTINCT l_returnflag) AS k FROM lineitem
UNION ALL SELECT 'l_linestatus', COUNT(DISTINCT l_linestatus) FROM lineitem UNION ALL SELECT 'l_linenumber', COUNT(DISTINCT l_linenumber) FROM lineitem
UNION ALL SELECT 'l_suppkey', COUNT(DISTINCT l_suppkey) FROM lineitem)
SELECT CAST(row_number() OVER (ORDER BY -k, control) - 1 AS INTEGER) AS place, control FROM c WHERE k > 1""",
    "fe_components": """WITH RECURSIVE tied AS (SELECT DISTINCT l_suppkey AS a, 1000000000 + l_orderkey AS b FROM lineitem),
two AS (SELECT DISTINCT t.a, u.a AS c FROM tied t JOIN tied u ON t.b = u.b),
walk(a, c) AS (SELECT a, a FROM two UNION SELECT w.a, t.c FROM walk w JOIN two t ON t.a = w.c),
part AS (SELECT a, MIN(c) AS c FROM walk GROUP BY a)
SELECT COUNT(DISTINCT c) AS components, COUNT(*) + (SELECT COUNT(DISTINCT b) FROM tied) - COUNT(DISTINCT c) AS rank FROM part""",
    "ci_pointwise": POINTWISE_SQL,
    "ci_pointwise_control": POINTWISE_CONTROL_SQL,
    "ci_rbc": _interval_sql("rbc", 10, []),
    "ci_rbc_two_way_fe": _interval_sql("rbc", 5, [*LINES, *FLAGS, "l_tax"]),
    "ci_pointwise_fe": _interval_sql("pointwise", 5, [*FLAGS, "l_tax"]),
    "poly_line_1": _poly_sql(1),
    "poly_line_2": _poly_sql(2),
    "poly_line_3": _poly_sql(3),
    "one_hot": """SELECT CAST(SUM(CAST(l_returnflag = 'N' AS INT)) AS DOUBLE) AS sum_0, CAST(SUM(CAST(l_returnflag = 'R' AS INT)) AS DOUBLE) AS sum_1, COUNT(*) AS n FROM lineitem""",
    "one_hot_names": """SELECT v AS level, '__ctrl_l_returnflag_' || v || '_' || left(md5(concat('l_returnflag=', chr(39), v, chr(39))), 8) AS name
FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) WHERE v > (SELECT MIN(l_returnflag) FROM lineitem)""",
    "figure_ranges": """SELECT ROUND(MIN(o_totalprice) - 0.06872 * (MAX(o_totalprice) - MIN(o_totalprice)), 7) AS low,
ROUND(MAX(o_totalprice) + 0.06872 * (MAX(o_totalprice) - MIN(o_totalprice)), 7) AS high FROM orders""",
}
