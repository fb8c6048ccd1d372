from pyspark.sql import functions as F

from factlens.operators import shuffle as sh


def test_places_are_a_bijection_for_every_n(spark):
    for n in (1, 2, 3, 5, 8, 17, 64, 100, 1000):
        rows = spark.range(n).select("id", sh.place(F.col("id"), n, 3).alias("p"))
        rows = rows.withColumn("back", sh.row_at(F.col("p"), n, 3)).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_orders_differ_by_key_and_look_random(spark):
    n = 1000
    one, two = ([r.p for r in spark.range(n).select(sh.place(F.col("id"), n, k).alias("p")).collect()] for k in (1, 2))
    assert one != two
    assert sum(a == i for i, a in enumerate(one)) < 10 and 300 < sum(a < b for a, b in zip(one, one[1:])) < 700


def test_shuffled_table_and_its_batches(spark):
    df = spark.createDataFrame([(f"u{i:03d}", i) for i in range(103)], "uuid string, v int")
    got = sh.shuffled(df.repartition(5), ["uuid"], key=7, batch_rows=10).collect()
    again = sh.shuffled(df.coalesce(1), ["uuid"], key=7, batch_rows=10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and sorted(r.place for r in got) == list(range(103))
    assert sh.shuffled(df.limit(0), ["uuid"]).count() == 0
    numbered = spark.createDataFrame([(i, f"u{i:03d}") for i in range(103)], "idx long, uuid string")
    for b in (0, 10):
        want = sorted(r.uuid for r in got if r.batch == b)
        assert sorted(r.uuid for r in sh.batch_of(numbered, "idx", 103, b, 10, key=7).collect()) == want


def test_places_are_computed_by_many_tasks(spark):
    """A small table's few partitions don't bound the tasks that hash its rows."""
    df = spark.createDataFrame([(f"u{i:03d}",) for i in range(50)], "uuid string").coalesce(1)
    assert sh.shuffled(df, ["uuid"], key=7).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
