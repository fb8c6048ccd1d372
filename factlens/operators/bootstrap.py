"""Bootstrap bands of means.

A replicate weighs each row by a Poisson(1) number instead of drawing rows
with replacement (the same in the limit, and mergeable): the number comes from
a hash of the row's identity and the replicate, so replicates need no second
pass and no state, and any partitioning gives the same band.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.hashing import h32

#: hash values from which the weight is at least 1, 2, ... (Poisson distribution with mean 1)
POISSON_STEPS = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def poisson_weight(*parts) -> Column:
    h = h32(*parts)
    return sum(((h >= F.lit(t)).cast("int") for t in POISSON_STEPS[1:]), (h >= F.lit(POISSON_STEPS[0])).cast("int"))


def mean_band(rows: DataFrame, keys: list[str], value: str, row_id: Column, replicates: int = 200,
              level: float = 0.95) -> DataFrame:
    """``keys..., lo, hi, n_replicates``: the percentile interval of the mean of
    ``value`` by key (null keys are groups).  Replicates that weigh all rows of
    a key 0 have no mean and are left out; nulls are no values.  Rows are
    summed by (key, replicate) before the shuffle, so a key costs
    ``replicates`` rows for each task."""
    v = rows.select(*keys, F.col(value).cast("double").alias("_v"), row_id.cast("string").alias("_id")).filter(F.col("_v").isNotNull())
    drawn = v.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", poisson_weight("_id", "_b"))
    sums = drawn.groupBy(*keys, "_b").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"))
    tail = (1 - level) / 2
    means = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    return sums.groupBy(*keys).agg(
        F.percentile(means, tail).alias("lo"), F.percentile(means, 1 - tail).alias("hi"),
        F.count(means).cast("bigint").alias("n_replicates"))
