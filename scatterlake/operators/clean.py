"""Column checks, classification and cleaning of the input frame."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import column, finite, scaled
from ..plans.options import Options


@dataclass(frozen=True)
class Clean:
    """The cleaned frame (``_x _y _w0.. _g0..``) and what one pass over it says.

    ``_x``, ``_y`` and ``_w`` are doubles; ``_g`` keep their own types. Names of the
    input never reach an expression, so no control can collide with anything.
    """

    df: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]  # controls that vary, most levels first
    groups: tuple[str, ...]  # their columns
    n: int
    mean: dict[str, float]
    scale: dict[str, float]
    low: float
    high: float
    distinct: int  # of x, about

    def std(self, name: str) -> Column:
        """A numeric column, centred and scaled, so that products keep their digits."""
        return scaled(F.col(name), self.mean[name], self.scale[name])

    @property
    def x(self) -> Column:
        return self.std("_x")

    @property
    def y(self) -> Column:
        return self.std("_y")

    @property
    def w(self) -> list[Column]:
        return [self.std(f"_w{i}") for i in range(len(self.numeric))]

    def binned(self, df: DataFrame) -> Clean:
        """The same data with further columns."""
        return replace(self, df=df)

    def unscaled_x(self, value: float) -> float:
        return value * self.scale["_x"] + self.mean["_x"]


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and other columns of a frame, in order (Boolean is not numeric)."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in df.schema if f.name not in numeric]


def classify(df: DataFrame, options: Options) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Numeric and categorical controls, after checking that all columns can be used."""
    if len(df.columns) < 2:
        raise TypeError("Input dataframe must have at least 2 columns")
    for name in (options.x, options.y, *options.controls):
        if name not in df.columns:
            raise ValueError(f"{name} not in input dataframe")
    kinds = {f.name: f.dataType for f in df.schema}
    for what, name in (("x", options.x), ("y", options.y)):
        if not isinstance(kinds[name], T.NumericType):
            raise TypeError(f"{what} column {name!r} must be numeric, not {kinds[name].simpleString()}")
    for name in options.controls:
        if isinstance(kinds[name], (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
            raise TypeError(f"control {name!r} cannot be grouped by its type {kinds[name].simpleString()}")
    for name in options.categorical:
        if isinstance(kinds[name], (T.FloatType, T.DoubleType)):
            raise TypeError(f"categorical control {name!r} must not be a float column")
    numeric = tuple(c for c in options.controls if isinstance(kinds[c], T.NumericType) and c not in options.categorical)
    return numeric, tuple(c for c in options.controls if c not in numeric)


def valid_rows(df: DataFrame, options: Options) -> tuple[DataFrame, tuple[str, ...], tuple[str, ...]]:
    """The rows whose used columns are all present and finite, under internal names."""
    numeric, categorical = classify(df, options)
    number = {"_x": options.x, "_y": options.y} | {f"_w{i}": c for i, c in enumerate(numeric)}
    group = {f"_g{i}": c for i, c in enumerate(categorical)}
    out = df.select(*[column(c).cast("double").alias(k) for k, c in number.items()], *[column(c).alias(k) for k, c in group.items()])
    # ranged over actual types: an integer column marked categorical only needs to be present
    keep = F.lit(True)
    for k in number:
        keep = keep & finite(F.col(k))
    for k in group:
        keep = keep & F.col(k).isNotNull()
    return out.where(keep), numeric, categorical


def clean(df: DataFrame, options: Options, persist: bool = True) -> Clean:
    """Clean, and take count, means, scales, range and numbers of levels in one pass."""
    rows, numeric, categorical = valid_rows(df, options)
    if persist:
        rows = rows.persist()
    number = ["_x", "_y", *[f"_w{i}" for i in range(len(numeric))]]
    stats = [F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.approx_count_distinct("_x", 0.05).alias("u")]
    for k in number:
        stats += [F.avg(k).alias(f"m{k}"), F.max(F.abs(F.col(k))).alias(f"a{k}"), F.stddev_pop(k).alias(f"v{k}")]
    stats += [F.count_distinct(F.col(f"_g{i}")).alias(f"d{i}") for i in range(len(categorical))]
    row = rows.agg(*stats).first()
    if not row["n"]:
        _explain_empty(df, options)
    mean = {k: row[f"m{k}"] for k in number}
    size = {k: row[f"a{k}"] or 1.0 for k in number}
    scale = {k: row[f"v{k}"] for k in number}
    odd = [k for k in number if not (math.isfinite(scale[k]) and scale[k] > 0)]
    if odd:  # constants, or squares out of range: divide by the largest size before squaring
        spread = rows.agg(*[F.sqrt(F.avg(((F.col(k) - mean[k]) / size[k]) ** 2)).alias(k) for k in odd]).first()
        scale |= {k: (spread[k] * size[k]) or 1.0 for k in odd}
    levels = sorted(((-row[f"d{i}"], c, f"_g{i}") for i, c in enumerate(categorical) if row[f"d{i}"] > 1), key=lambda v: v[:2])
    return Clean(
        rows, numeric, tuple(c for _, c, _ in levels), tuple(g for *_, g in levels), row["n"], mean, scale, row["low"], row["high"], row["u"]
    )


def _explain_empty(df: DataFrame, options: Options) -> None:
    """Name the column that leaves no row."""
    used = [options.x, options.y, *options.controls]
    kinds = {f.name: f.dataType for f in df.schema}
    ok = [finite(column(c).cast("double")) if isinstance(kinds[c], T.NumericType) else column(c).isNotNull() for c in used]
    row = df.agg(*[F.sum(e.cast("long")).alias(f"c{i}") for i, e in enumerate(ok)]).first()
    bad = [c for i, c in enumerate(used) if not row[f"c{i}"]]
    raise ValueError(f"no valid row: {', '.join(bad)} hold(s) no finite value" if bad else "no row has finite values in all used columns")
