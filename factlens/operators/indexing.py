"""Dense 0-based row index within a group, without a window per group.

``row_number() over (partition by g order by o)`` puts a whole group in
one task; a group holding a third of all rows would then be sorted by a
single task.  Here the frame is range-partitioned on (g, o) instead, so a
big group is spread over many contiguous partitions, and a prefix sum of
per-partition counts (one small row per partition and group) turns the
position inside each partition into the position inside the group.

The result depends only on the data, provided (g, o) orders rows totally.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.store import persisted

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | position

#: Rows of a task that draws or shuffles by hash: few bytes, but much work.
WORK_ROWS = 100_000


def spread_work(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows of ``df`` over tasks of at most about ``WORK_ROWS``, two for
    each core at least: partitions made for their bytes would be too few."""
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / WORK_ROWS))
    return df.repartition(tasks, key)


def group_index(df: DataFrame, group: list[str], order: list[str], col: str = "idx") -> DataFrame:
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    mid = F.monotonically_increasing_id()
    t = ranged.withColumn("_mid", mid)
    # written before its two uses: partition numbers of two separate range
    # exchanges would not agree
    t = persisted(t.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
                   .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))).drop("_mid"), "ranged")
    # per (partition, group): how many rows and where the group starts
    parts = t.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_loc").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    out = t.join(parts.select("_pid", *group, "_first", "_before"), ["_pid", *group])
    return out.withColumn(col, (F.col("_before") + F.col("_loc") - F.col("_first")).cast("bigint")) \
              .drop("_pid", "_loc", "_first", "_before")
