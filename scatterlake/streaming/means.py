"""Bin means of a stream, on edges that are fixed beforehand.

Sums per bin are additive, so a streaming aggregation maintains them; edges of a
sample or of history (see ``operators.quantiles``) make the bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, column, finite
from ..operators.quantiles import interior_edges


def streaming_bin_means(stream: DataFrame, x: str, y: str, edges: Sequence[float], time: str | None = None, window: str = "1 hour",
                        watermark: str = "1 hour") -> DataFrame:
    """bin, n, mean of x and of y; per event-time window if ``time`` names a timestamp."""
    cx, cy = column(x).cast("double"), column(y).cast("double")
    rows = stream.where(finite(cx) & finite(cy))
    interior = interior_edges(edges, edges[0], edges[-1])  # ties and two values as in a batch
    keys = [bin_index(cx, interior).cast("int").alias("bin")]
    if time is not None:
        rows = rows.withWatermark(time, watermark)
        keys.insert(0, F.window(column(time), window).alias("window"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(cx).alias("mean_x"), F.avg(cy).alias("mean_y"))
