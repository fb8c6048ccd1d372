"""Parquet tables of a scale-factor folder.

``table`` returns a lazy scan; Catalyst prunes its columns and pushes
filters into the parquet reader, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_SCANS: dict = {}


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one table; the scan object is reused within a session so
    the file listing and footer reads happen once."""
    path = table_path(sf_dir, name)
    key = (id(spark), path)
    df = _SCANS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _SCANS[key] = df
    return df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cluster's cores when it yields fewer input
    partitions than that (a single-file table); a no-op for inputs that
    are already split, as any large table is.  Filters and column pruning
    still reach the parquet reader below the repartition."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
