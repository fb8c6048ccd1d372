from factlens.session import bounded_broadcast, row_count_at_most, rows_and_bytes


def test_size_proof_with_huge_bound(spark):
    df = spark.range(5)
    assert row_count_at_most(df, 10**12) == 5          # bound beyond a 32-bit limit
    assert row_count_at_most(df, 3) == 4                # stops at bound + 1
    assert bounded_broadcast(df, 10**12).count() == 5


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([("a" * 100, [1, 2]), (None, None)], "s string, n array<int>")
    rows, size = rows_and_bytes(df)
    assert rows == 2 and 100 < size < 200
    plan = bounded_broadcast(df, 10, max_bytes=size)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan
    assert "broadcast" not in bounded_broadcast(df, 10, max_bytes=size - 1)._jdf.queryExecution().logical().toString()
    assert rows_and_bytes(df.limit(0)) == (0, 0)
