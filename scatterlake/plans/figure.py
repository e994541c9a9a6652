"""The figure of a binned scatter plot, as the JSON-shaped dict that plotly reads."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

MARGIN = 0.06872  # fixed value: share of the span left free on either side
SIZE = 8  # fixed value: markers, unless a size is given
CURVE = "rgba(31, 119, 180, 0.95)"  # fixed value
OWN = ("x", "y", "range_x", "range_y")  # set by the plot
#: What a scatter's keywords become in the layout.
LAYOUT = {"template": "template", "width": "width", "height": "height"}


def axis_range(low: float, high: float) -> list[float]:
    pad = (high - low) * MARGIN if high > low else 1.0
    return [low - pad, high + pad]


def figure(rows: Sequence[dict], x: str, y: str, bounds: tuple[float, float], num_bins: int, polynomial=None, has_ci=False, **kwargs) -> dict:
    """Dots, then the intervals, then the polynomial; the y range follows dots and intervals only.

    Keywords style the dots: size, opacity, color (one per dot), color_discrete_sequence,
    symbol, hover_name, text, labels (titles of x and y), title, template, width, height, log_x, log_y.
    """
    if len(rows) < num_bins or len({r["x"] for r in rows}) < num_bins:
        raise ValueError("Quantiles are not unique. Decrease number of bins.")  # fixed value
    for name in [k for k in OWN if k in kwargs]:
        warnings.warn(f"{name} is set by the plot and is ignored", UserWarning, stacklevel=3)
        kwargs.pop(name)
    if "size" in kwargs:
        warnings.warn("markers take the given size instead of the default", UserWarning, stacklevel=3)
    labels = {x: x, y: y, "x": x, "y": y} | dict(kwargs.pop("labels", None) or {})
    marker = {"size": kwargs.pop("size", SIZE), "color": (kwargs.pop("color_discrete_sequence", None) or ["black"])[0]}
    for name in ("color", "opacity", "symbol"):
        if name in kwargs:
            value = kwargs.pop(name)
            marker[name] = value if isinstance(value, (str, int, float)) else list(value)
    dots = {"type": "scatter", "mode": "markers", "name": "", "showlegend": False, "x": [r["x"] for r in rows], "y": [r["y"] for r in rows], "marker": marker}
    for name, key in (("hover_name", "hovertext"), ("text", "text")):
        if name in kwargs:
            dots[key] = list(kwargs.pop(name))
    traces, seen = [dots], list(dots["y"])
    if has_ci:
        xs, ys = [], []
        for r in rows:
            xs += [r["x"], r["x"], None]
            ys += [r["ci_lower"], r["ci_upper"], None]
        seen += [v for v in ys if v is not None]
        traces.append({"type": "scatter", "mode": "lines", "name": "Confidence interval", "showlegend": False, "hoverinfo": "skip",
                       "x": xs, "y": ys, "line": {"color": "black", "width": 1}})
    if polynomial is not None:
        traces.append({"type": "scatter", "mode": "lines", "name": f"Polynomial fit (deg {polynomial.degree})", "showlegend": False,
                       "x": list(polynomial.grid_x), "y": list(polynomial.grid_y), "line": {"color": CURVE, "width": 2}})
    layout = {
        "template": "simple_white",
        "xaxis": {"title": {"text": labels["x"]}, "range": axis_range(*bounds)},
        "yaxis": {"title": {"text": labels["y"]}, "range": axis_range(min(seen), max(seen))},
    }
    if "title" in kwargs:
        layout["title"] = {"text": kwargs.pop("title")}
    for name, axis in (("log_x", "xaxis"), ("log_y", "yaxis")):
        if kwargs.pop(name, False):
            layout[axis] |= {"type": "log", "range": None}
    layout |= {LAYOUT[k]: kwargs.pop(k) for k in list(kwargs) if k in LAYOUT}
    if kwargs:
        raise TypeError(f"the plot has no keyword {', '.join(sorted(kwargs))}")
    return {"data": traces, "layout": layout}


def as_plotly(spec: dict):
    """A plotly figure where plotly is installed, else the dict itself."""
    try:
        import plotly.graph_objects as go
    except ImportError:
        return spec
    return go.Figure(spec)
