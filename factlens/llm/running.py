"""Running totals of any order without a window over a whole group.

Rows are range-partitioned by (group, order) and written; one row for each
range and group carries the ranges' totals, whose prefix sums are added to
the totals inside each range.  A group of a third of all rows is spread over
many ranges, provided (group, order) tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.llm.common import written


def running_totals(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the total of its column over the
    rows of the same ``group`` (no nulls there) that come before in ``order``."""
    measured = df.select("*", *[c.cast("bigint").alias(f"_add_{n}") for n, c in sums.items()])
    ranged = written(measured.repartitionByRange(*[F.asc(g) for g in group], *order)
                     .withColumn("_part", F.spark_partition_id()), "ranges")
    # at most one row for each range and one for each group
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(f"_add_{n}").alias(f"_all_{n}") for n in sums])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *group, *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums])
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(f"_add_{n}").over(inside), F.lit(0)).alias(f"_in_{n}") for n in sums])
    return local.join(base, ["_part", *group]).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in sums],
        *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])
