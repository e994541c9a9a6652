"""One-hot columns of categorical controls (what absorbing them is equivalent to)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import column

# The prefix __ctrl_, the longest name, and eight digits of the digest.
MAX_NAME = 64


def dummy_name(control: str, value: object) -> str:
    """A safe and unique name for the indicator of a level."""
    clean = lambda s: re.sub(r"\W+", "_", str(s)).strip("_") or "x"
    digest = hashlib.md5(f"{control}={value!r}".encode()).hexdigest()[:8]
    return f"__ctrl_{clean(control)}_{clean(value)}"[: MAX_NAME - 9] + f"_{digest}"


def levels(df: DataFrame, controls: tuple[str, ...]) -> dict[str, list]:
    """Sorted levels of each control, in one pass (for controls of few levels)."""
    if not controls:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(column(c))).alias(f"c{i}") for i, c in enumerate(controls)]).first()
    return {c: list(row[f"c{i}"]) for i, c in enumerate(controls)}


def one_hot(df: DataFrame, controls: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """Adds an indicator per level but the first; constants add none and null is 0 everywhere."""
    added = {}
    for c, found in levels(df, controls).items():
        for value in found[1:]:
            added[dummy_name(c, value)] = F.when(column(c) == F.lit(value), 1.0).otherwise(0.0)
    return df.withColumns(added) if added else df, tuple(added)
