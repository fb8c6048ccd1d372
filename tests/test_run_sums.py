import random
from decimal import Decimal

from pyspark.sql import functions as F

from factlens.operators import evaluation as ev
from factlens.streaming import summaries as sm


def test_sums_of_whole_numbers_and_fractions_are_exact(spark):
    rng, some = random.Random(1), [0.0, 1.0, -0.0, 0.5, 1 / 3, 0.1, 1e-19, 3e9, 12345.678, -7.0, None]
    rows = [("m", 0, "nl", False, 0, f"r{i % 3}", rng.choice([1, -1]), [rng.choice(some) for _ in ev.METRIC_COLS]) for i in range(200)]
    rows += [("m", 0, "nl", False, 0, "none", 1, [None] * 7), ("m", 0, "nl", False, 0, "one", 1, [1.0] * 7), ("m", 0, "nl", False, 0, "half", 1, [0.5] * 7)]
    changes = spark.createDataFrame(rows, sm.CHANGE_SCHEMA)
    plain = [F.sum(F.get("m", F.lit(i)).cast("decimal(38,18)") * F.col("sign").cast("decimal(1,0)")).cast("decimal(38,18)").alias(s) for i, s in enumerate(sm.SUM_COLS)]
    want = {r.rel: [r[s] for s in sm.SUM_COLS] for r in changes.groupBy("rel").agg(*plain).collect()}
    sums = sm.run_sums(changes)
    assert {r.rel: [r[s] for s in sm.SUM_COLS] for r in sums.collect()} == want
    assert want["none"] == [None] * 7 and want["one"] == [Decimal(1)] * 7
    assert {t for c, t in sums.dtypes if c in sm.SUM_COLS} == {"decimal(38,18)"}
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("rint") >= 7
