"""Read tables and bring fixed-width text into shape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def rtrim_text(df: DataFrame, *columns: str) -> DataFrame:
    """Strip the blank padding of fixed-width text (all text columns by default),
    so that equality and joins mean the same as on padded values."""
    chosen = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.rtrim(F.col(c)) for c in chosen})


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Column defaults, applied to nulls at load."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in defaults.items()})


def like_table(df: DataFrame) -> DataFrame:
    """An empty table of the same shape."""
    return df.sparkSession.createDataFrame([], df.schema)
