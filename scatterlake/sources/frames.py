"""Where input frames come from: Spark, pandas, and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READERS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": True, "inferSchema": True}}


def as_frame(df) -> DataFrame:
    """A Spark DataFrame as it is; a pandas one through Arrow."""
    if isinstance(df, DataFrame) or (hasattr(df, "sparkSession") and hasattr(df, "schema")):
        return df
    if type(df).__module__.startswith("pandas"):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise TypeError("a pandas frame needs an active Spark session")
        if df.shape[1] < 2:
            raise TypeError("Input dataframe must have at least 2 columns")
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
        return spark.createDataFrame(df)
    raise TypeError(f"expected a Spark or pandas DataFrame, not {type(df).__name__}")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """A table from files; with a schema, text formats are read once instead of twice."""
    if kind == "stata":  # a single-file format that Spark has no reader for
        import pandas as pd

        return as_frame(pd.read_stata(path, **options))
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; one of {sorted([*READERS, 'stata'])}")
    settings = READERS[kind] | options
    reader = spark.read.format(kind)
    if schema is not None:
        settings.pop("inferSchema", None)
        reader = reader.schema(schema)
    return reader.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in settings.items()}).load(path)
