from pyspark.sql import functions as F

from factlens.functions import parsing as ps


def test_list_literals(spark):
    lits = ["['a', 'b']", "[\"it's\", 'x']", "['a\\'b']", "[]", "[0.5, 2e-05]", "['line\\nbreak']"]
    df = spark.createDataFrame([(x,) for x in lits], "s string")
    got = [r.v for r in df.select(ps.parse_list_literal(F.col("s")).alias("v")).collect()]
    assert got[0] == ["a", "b"] and got[1] == ["it's", "x"] and got[2] == ["a'b"] and got[3] == []
    assert got[5] == ["line\nbreak"]
    nums = df.filter(F.col("s").startswith("[0")).select(ps.parse_list_literal(F.col("s"), "double").alias("v")).first().v
    assert nums == [0.5, 2e-05]


def test_render_then_parse_round_trip(spark):
    items = ["plain", "it's", 'say "hi"', "back\\slash", "both ' and \""]
    df = spark.createDataFrame([(items,)], "w array<string>")
    r = df.select(ps.render_list(F.col("w")).alias("lit"),
                  ps.parse_list_literal(ps.render_list(F.col("w"))).alias("back")).first()
    assert r.lit == repr(items) and r.back == items


def test_run_paths(spark):
    paths = ["out/TREx/bert-base-cased/pe-10_nl-True_ce-False_rs-3.csv",
             "/x/y/Google_RE/t5-large/pe-0_nl-par_ce-True_rs-0.csv",
             "out/TREx/summary.csv", "out/TREx/m/pe-1_nl-nl_ce-True_rs-0.csv.bak"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.filter(ps.is_run_path(F.col("path"))).select(*ps.run_key(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("TREx", "bert-base-cased", 10, "nl", False, 3),
                                      ("Google_RE", "t5-large", 0, "par", True, 0)]


def test_unknown_priming_name_raises(spark):
    df = spark.createDataFrame([("d/m/pe-1_nl-zzz_ce-True_rs-0.csv",)], "path string")
    try:
        df.select(*ps.run_key(F.col("path"))).collect()
    except Exception as e:  # noqa: BLE001
        assert "unknown priming type" in str(e)
    else:
        raise AssertionError("expected an error")


def test_kv_line(spark):
    df = spark.createDataFrame([("games:g/hard,agent:lmkb,num_priming_examples:10,score:0.5,steps:44.0",)], "l string")
    m = df.select(ps.parse_kv_line(F.col("l")).alias("m")).first().m
    assert m["agent"] == "lmkb" and float(m["score"]) == 0.5 and int(m["num_priming_examples"]) == 10
