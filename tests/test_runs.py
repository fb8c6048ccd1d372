from pyspark.sql import functions as F

from factlens.operators import runs as rn

KEY = "data string, model string, num_examples bigint, priming_type string, use_close_examples boolean, random_seed bigint"


def _summary(spark, rows):
    return spark.createDataFrame(rows, KEY + ", p_at_1 double, ingest_seq bigint")


def test_upsert_keeps_last_and_is_idempotent(spark):
    old = _summary(spark, [("TREx", "m", 0, "nl", False, 0, 0.1, 1), ("TREx", "m", 0, "nl", False, 1, 0.2, 1)])
    new = _summary(spark, [("TREx", "m", 0, "nl", False, 1, 0.9, 2), ("TREx", "m", 3, "nl", False, 0, 0.5, 2)])
    u = rn.upsert(old, new)
    got = {r.random_seed * 10 + r.num_examples: (r.p_at_1, r.ingest_seq) for r in u.collect()}
    assert got == {0: (0.1, 1), 10: (0.9, 2), 3: (0.5, 2)}
    assert sorted(rn.upsert(u, new).collect()) == sorted(u.collect())


def test_repair_priming_type(spark):
    df = spark.createDataFrame([(None, True), (None, False), ("par", False)], "priming_type string, use_natural_language boolean")
    assert [r.priming_type for r in rn.repair_priming_type(df).collect()] == ["nl", "rarr", "par"]


def test_t5_adjustment_only_on_dataset_totals(spark):
    df = spark.createDataFrame([("TREx", "t5-large", 0.5), ("TREx_N-1", "t5-large", 0.5), ("ConceptNet", "t5-base", 0.5),
                                ("TREx", "bert", 0.5)], "data string, model string, p_at_1 double")
    got = [r.p_at_1_adj for r in rn.adjust_p1(df).collect()]
    assert got == [0.5 * 0.7789, 0.5, 0.5 * 0.379, 0.5]


def test_grid_explosion_and_config_lookup(spark):
    grid = [("m1", 0, "nl", False, 0), ("m2", 3, "par", True, 1)]
    df = spark.createDataFrame([("u1",)], "uuid string")
    e = rn.explode_runs(df, grid, {"_tag": rn.config_tag})
    assert sorted((r.run_id, r._tag) for r in e.collect()) == [(0, "m1|0|nl|false|0"), (1, "m2|3|par|true|1")]
    c = rn.with_config(e, grid).filter(F.col("model") == "m2").first()
    assert (c.num_examples, c.priming_type, c.use_close_examples, c.random_seed) == (3, "par", True, 1)
