from pyspark.sql import Window
from pyspark.sql import functions as F

from factlens.operators import priming as pr
from factlens.operators.indexing import group_index


def _examples(spark):
    rows = []
    for rel, n_subj in (("big", 30), ("one", 1), ("two", 2)):
        for s in range(n_subj):
            for y in range(1 + s % 3):
                rows.append((f"{rel}_{s}_{y}", rel, f"s{s:02d}", f"y{y}", f"s{s:02d} in [MASK] ."))
    return spark.createDataFrame(rows, "uuid string, rel string, subj string, y string, x string")


def test_group_index_equals_row_number(spark):
    e = _examples(spark).repartition(5)
    a = group_index(e, ["rel"], ["subj", "uuid"]).select("uuid", "idx")
    b = e.select("uuid", (F.row_number().over(Window.partitionBy("rel").orderBy("subj", "uuid")) - 1).alias("idx"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_draws_exclude_own_subject_and_count(spark):
    e = _examples(spark)
    draws, ix = pr.draw_random(e, k=5, seed=7)
    pool = ix.select("rel", "idx", F.col("subj").alias("p_subj"))
    j = draws.join(pool, ["rel", "idx"])
    assert j.filter(F.col("subj") == F.col("p_subj")).count() == 0
    per = {r.uuid: r.n for r in draws.groupBy("uuid").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r.uuid: (r.n - r.own) for r in ix.collect()}
    for u, m in sizes.items():
        assert per.get(u, 0) == min(5, m)


def test_prime_random_nl_and_symbolic(spark):
    e = _examples(spark)
    nl = {r.uuid: r for r in pr.prime_random(e, k=3, seed=1).collect()}
    one = nl["one_0_0"]
    assert one.n_primes == 0 and one.x_primed == "s00 in [MASK] ."            # single-subject relation
    big = nl["big_5_0"]
    lines = big.x_primed.split("\n")
    assert big.n_primes == 3 and len(lines) == 4 and lines[-1] == "s05 in [MASK] ."
    assert all("[MASK]" not in ln and not ln.startswith("s05 ") for ln in lines[:-1])
    two = nl["two_0_0"]                                                        # pool = the other subject's 2 rows
    assert two.n_primes == 2
    sym = {r.uuid: r for r in pr.prime_random(e, k=3, seed=1, priming="{} -> {}").collect()}
    assert sym["one_0_0"].x_primed == "s00 -> [MASK]\n"
    assert sym["big_5_0"].x_primed.endswith("\ns05 -> [MASK]\n")
    assert len(sym["big_5_0"].x_primed.split("\n")) == 5


def test_priming_is_partitioning_invariant(spark):
    e = _examples(spark)
    a = pr.prime_random(e.repartition(1), k=3, seed=2).select("uuid", "x_primed").collect()
    b = pr.prime_random(e.repartition(7), k=3, seed=2).select("uuid", "x_primed").collect()
    assert sorted(a) == sorted(b)


def test_group_index_with_a_hot_group(spark):
    rows = [("hot", f"s{i % 97:03d}", f"u{i:05d}") for i in range(3000)]
    rows += [("cold", f"s{i}", f"c{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "rel string, subj string, uuid string").repartition(16)
    got = group_index(df, ["rel"], ["subj", "uuid"]).select("rel", "uuid", "idx")
    want = df.select("rel", "uuid", (F.row_number().over(Window.partitionBy("rel").orderBy("subj", "uuid")) - 1)
                     .alias("idx"))
    assert sorted(got.collect()) == sorted(want.collect())
    hot = sorted(r.idx for r in got.filter(F.col("rel") == "hot").collect())
    assert hot == list(range(3000))


def test_pool_apart_from_examples(spark):
    rows = [("a1", "r", "a", ["x", "y"]), ("b1", "r", "b", ["z"]), ("c1", "r", "c", []), ("d1", "alone", "d", [])]
    e = spark.createDataFrame(rows, "uuid string, rel string, subj string, y array<string>").withColumn("x", F.col("subj"))
    got = {r.uuid: r for r in pr.prime_random(e, 5, 1, "{} -> {}", pool=e.filter(F.size("y") > 0)).collect()}
    assert set(got) == {"a1", "b1", "c1", "d1"}
    assert got["d1"].n_primes == 0 and got["d1"].x_primed == "d -> [MASK]\n"     # no pool
    assert got["a1"].x_primed == "b -> z\na -> [MASK]\n"                          # own subject left out
    lines = got["c1"].x_primed.split("\n")[:2]                                     # unsolvable: primed, never drawn
    assert got["c1"].n_primes == 2 and set(lines) <= {"a -> x", "a -> y", "b -> z"}
    assert not any(ln.startswith("c ") for r in got.values() for ln in r.x_primed.split("\n")[:-2])
