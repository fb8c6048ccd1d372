from pyspark.sql import functions as F

from factlens.operators import commands as cm
from factlens.operators import textops as tx


def test_command_filter_rules(spark):
    cmds = ["examine cookbook", "examine apple", "look", "inventory", "open door", "close box", "drop key",
            "take apple from table", "take knife from counter", "go east", "looking glass"]
    df = spark.createDataFrame([(cmds, ["knife"])], "c array<string>, stored array<string>")
    r = df.select(cm.useful_commands(F.col("c")).alias("f")).first().f
    assert r == ["examine cookbook", "take apple from table", "take knife from counter", "go east", "looking glass"]
    t = df.select(cm.take_choices(cm.useful_commands(F.col("c")), F.col("stored")).alias("t")).first().t
    assert t == ["take apple from table"]
    m = df.select(cm.first_mentioning(F.col("c"), F.lit("counter")).alias("m")).first().m
    assert m == "take knife from counter"


def test_cap_draws_without_replacement(spark):
    df = spark.createDataFrame([([f"go {i}" for i in range(20)],)], "c array<string>")
    r = df.select(cm.cap_commands(F.col("c"), 5, 0, F.lit("x")).alias("k")).first().k
    assert len(r) == 5 and len(set(r)) == 5
    small = df.select(cm.cap_commands(F.slice("c", 1, 3), 5, 0, F.lit("x")).alias("k")).first().k
    assert small == ["go 0", "go 1", "go 2"]


def test_inventory_and_observation(spark):
    df = spark.createDataFrame([("You are carrying nothing.",), ("You are carrying:\n  a red apple\n  a pair of socks\n  some milk",)],
                               "s string")
    got = [r.i for r in df.select(tx.inventory_items(F.col("s")).alias("i")).collect()]
    assert got == [[], ["red apple", "socks", "milk"]]
    o = spark.createDataFrame([("Intro. Welcome to TextWorld!  Room text. -= Hall =-", "-= Hall =-")], "o string, d string")
    assert o.select(tx.clean_observation(F.col("o"), F.col("d")).alias("x")).first().x == "Room text."
