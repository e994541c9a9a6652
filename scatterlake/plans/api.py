"""The entry point: a binned scatter plot of a table of any size.

Rows are only ever aggregated on the cluster. What reaches the driver is sums
per bin and per observed combination of categorical levels, and the few values
around each quantile.
"""

from __future__ import annotations

import logging
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import Clean, clean
from ..operators.fit import bin_means, fit_bins, fit_polynomial, hat_basis, indicator_basis
from ..operators.intervals import intervals
from ..operators.moments import bin_moments
from ..operators.quantiles import MOST_VALUES, approximate_quantiles, assign, edges_of, exact_quantiles, interior_edges
from ..operators.selectors import direct_plug_in, rule_of_thumb
from ..sources.frames import as_frame
from .figure import as_plotly, figure
from .options import Options, check

logger = logging.getLogger("scatterlake")
TOO_FEW_BINS = "Could not produce at least 2 bins; check the distribution of the x column."


def bin_plot(df, x, y, controls=None, num_bins="dpi", return_type="plotly", poly_line=None, categorical=None, ci="none", ci_level=0.95, *,
               quantile_method="exact", persist=True, **figure_options):
    """Mean of ``y`` in quantile bins of ``x``, adjusted for controls.

    df: a Spark DataFrame (a pandas one is accepted). controls: numeric columns are
    regressed on, all others (and those named in ``categorical``) are absorbed as
    fixed effects. num_bins: a number, "rule-of-thumb"/"rot", or "dpi". ci: "none",
    "pointwise" or "rbc" (robust to bias), at ``ci_level``. poly_line: degree of an
    overlaid polynomial (figures only). return_type: "native" for a DataFrame of
    ``bin, x, y[, ci_lower, ci_upper, ci_std_error]``, "plotly" for a figure.
    """
    options = check(x, y, controls, num_bins, return_type, poly_line, categorical, ci, ci_level, quantile_method)
    df = as_frame(df)
    data = clean(df, options, persist)
    try:
        rows, bins = _rows(data, options)
        if options.return_type == "native":
            return native(df.sparkSession, rows, options)
        curve = fit_polynomial(data, options.poly_line) if options.poly_line else None
        return as_plotly(figure(rows, x, y, (data.low, data.high), bins, curve, options.ci != "none", **figure_options))
    finally:
        if persist:
            data.df.unpersist()


def choose_bins(data: Clean, options: Options) -> int:
    if not options.automatic:
        return options.num_bins
    wanted = direct_plug_in(data) if options.num_bins == "dpi" else rule_of_thumb(data)
    if wanted > data.n > MOST_VALUES and data.distinct > MOST_VALUES:
        raise ValueError(f"Rule-of-thumb selected {wanted} bins for {data.n} rows; give a number of bins")
    return wanted


def bins_of(data: Clean, wanted: int, options: Options) -> tuple[list[float], int, Clean]:
    """Distinct quantile edges, the number of bins, and the data with each row's bin in ``_b``."""
    method = approximate_quantiles(data.df, "_x", wanted) if options.quantile_method == "approx" else exact_quantiles(data.df, "_x", wanted, data.n, data.distinct)
    edges, bins = edges_of(method)
    if len(edges) < 2:
        raise ValueError(TOO_FEW_BINS)
    if bins < wanted and not options.automatic:
        logger.warning("%d bins were asked for; ties in %s leave %d", wanted, options.x, bins)
    if data.n < bins:
        raise ValueError(f"Rule-of-thumb selected {bins} bins for {data.n} rows; give a smaller number of bins")
    return edges, bins, data.binned(assign(data.df, interior_edges(edges, data.low, data.high)))


def _rows(data: Clean, options: Options) -> tuple[list[dict], int]:
    edges, bins, data = bins_of(data, choose_bins(data, options), options)
    bin_ = F.col("_b")
    if options.ci == "pointwise" and options.automatic:
        warnings.warn("pointwise intervals at the IMSE-optimal number of bins undercover; use ci='rbc' or give a number of bins", UserWarning, stacklevel=3)
    m = None
    if not data.w and not data.groups:
        rows = [{"bin": b, "x": mx, "y": my} for b, _, mx, my in bin_means(data, bin_, bins)]
    else:
        m = bin_moments(data, bin_, bins)
        fit = fit_bins(m, indicator_basis(bins))
        dots = (fit.at_bins() @ fit.theta) * data.scale["_y"] + data.mean["_y"]
        rows = [{"bin": b, "x": data.unscaled_x(float(fit.x_mean[b])), "y": float(dots[b])} for b in range(bins)]
    if options.ci == "none":
        return rows, bins
    if len(rows) < bins:
        raise ValueError("Confidence intervals need every bin populated. Decrease number of bins.")
    if len(edges) != bins + 1:
        raise ValueError(f"Expected {bins + 1} bin edges for confidence intervals, found {len(edges)}")
    m = m or bin_moments(data, bin_, bins)
    if options.ci == "rbc":
        fit = fit_bins(m, hat_basis([(e - data.mean["_x"]) / data.scale["_x"] for e in edges]))
    else:
        fit = fit_bins(m, indicator_basis(bins))
    found = intervals(data, bin_, fit, m, options.ci_level)
    for r in rows:
        b = r["bin"]
        r |= {"ci_lower": float(found.lower[b]), "ci_upper": float(found.upper[b]), "ci_std_error": float(found.std_error[b])}
    return rows, bins


def native(spark: SparkSession, rows: list[dict], options: Options) -> DataFrame:
    """The result as a DataFrame sorted by bin."""
    names = ["bin", options.x, options.y]
    keys = ["bin", "x", "y"]
    if options.ci != "none":
        names += ["ci_lower", "ci_upper", "ci_std_error"]
        keys += ["ci_lower", "ci_upper", "ci_std_error"]
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "bin" else T.DoubleType(), False) for n in names])
    return spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], schema).coalesce(1).sortWithinPartitions("bin")
