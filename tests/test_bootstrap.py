import math
import random

import numpy as np
from pyspark.sql import functions as F

from factlens.operators import bootstrap as bs


def test_weights_are_poisson(spark):
    w = spark.range(20_000).select(bs.poisson_weight("id", F.lit(3)).alias("w")).groupBy("w").count().collect()
    got = {r.w: r["count"] / 20_000 for r in w}
    assert all(abs(got.get(k, 0) - math.exp(-1) / math.factorial(k)) < 0.015 for k in range(6))


def test_band_covers_the_mean_and_ignores_partitioning(spark):
    rng = random.Random(2)
    rows = [(None if i % 9 == 0 else "ab"[i % 2], float(i), rng.gauss(5, 2) if i % 50 else None) for i in range(900)] + [("one", 1.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, i double, v double")

    def band(x):
        return {r.g: (r.lo, r.hi, r.n_replicates) for r in bs.mean_band(x, ["g"], "v", F.col("i"), 300).collect()}

    got = band(df.repartition(7))
    again = band(df.coalesce(1))
    assert got.keys() == again.keys()
    assert all(np.allclose(got[g], again[g], rtol=1e-12) for g in got)
    for g in ("a", "b", None):
        v = [x for k, _, x in rows if k == g and x is not None]
        lo, hi, n = got[g]
        half = 1.96 * np.std(v) / math.sqrt(len(v))
        assert n == 300 and abs(lo - (np.mean(v) - half)) < half / 3 and abs(hi - (np.mean(v) + half)) < half / 3
    assert got["one"][:2] == (7.0, 7.0) and 150 < got["one"][2] < 230
