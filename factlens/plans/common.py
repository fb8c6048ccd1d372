"""Small helpers shared by the query bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """Round double outputs so two engines agree despite summation order."""
    cols = set(cols)
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def as_bigint(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in cols else F.col(c) for c in df.columns])
