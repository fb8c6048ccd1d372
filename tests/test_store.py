"""The store builds what isn't complete and notices changed inputs."""

import os

from factlens import store
from factlens.operators.indexing import group_index


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file:").removeprefix("//"))


def test_folder_without_success_is_rebuilt(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).repartition(4).write.parquet(src)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(src)

    first = store.stored(spark, "t", [src], build)
    at = folder(first)
    assert first.count() == 100 and len(built) == 1
    assert store.stored(spark, "t", [src], build).count() == 100 and len(built) == 1
    os.rename(f"{at}/_SUCCESS", f"{at}/_gone")
    assert store.stored(spark, "t", [src], build).count() == 100 and len(built) == 2


def test_changed_file_in_a_folder_changes_the_key(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).coalesce(1).write.parquet(src)
    before = store.input_fingerprint(spark, [src])
    spark.range(20).coalesce(1).write.mode("append").parquet(src)
    assert store.input_fingerprint(spark, [src]) != before


def test_group_index_is_the_row_number_on_many_rows(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        df = spark.range(600_000).selectExpr("id % 3 as g", "xxhash64(id) as o", "repeat('x', 40) as wide")
        got = group_index(df, ["g"], ["o"])
        n, least, most, distinct = got.selectExpr("count(*)", "min(idx)", "max(idx)", "count(distinct g, idx)").first()
        assert (n, least, most, distinct) == (600_000, 0, 199_999, 600_000)
        first = got.filter("idx < 50").orderBy("g", "idx").collect()
        want = df.selectExpr("*", "row_number() over (partition by g order by o) - 1 as idx").filter("idx < 50").orderBy("g", "idx").collect()
        assert [(r["g"], r["o"]) for r in first] == [(r["g"], r["o"]) for r in want]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
