import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factlens.config import RunConfig
from factlens.functions.parsing import first_of_batch, is_run_path, run_key
from factlens.operators import datasets as ds
from factlens.operators import reports as rp
from factlens.operators.prompts import generated_prediction
from factlens.operators.scoring import encode_subjects


def test_normalisers(spark):
    cn = spark.createDataFrame([("u1", "IsA", "cat", None, "cat", ["a [MASK] .", "b."])],
                               "uuid string, pred string, obj_label string, sub string, sub_label string, "
                               "masked_sentences array<string>")
    r = ds.load_examples("ConceptNet", cn).first()
    assert r.x == "a [MASK] . b." and r.subj == "cat"
    gre = spark.createDataFrame([("u2", "/people/person/date_of_birth", "Ann", "1900")],
                                "uuid string, pred string, sub_label string, obj_label string")
    assert ds.load_examples("Google_RE", gre).first().x == "Ann (born [MASK])."
    try:
        ds.load_examples("Squad", gre)
    except ValueError:
        pass
    else:
        raise AssertionError


def test_vocab_mode_and_generation(spark):
    assert ds.uses_shared_vocab("bert-base-cased") and not ds.uses_shared_vocab("t5-large")
    v = spark.createDataFrame([("Paris",), ("paris",)], "token string")
    assert ds.vocab_for_model(v, "albert-xxlarge-v2").count() == 1
    g = spark.createDataFrame([(" Paris. It is",)], "t string").select(generated_prediction(F.col("t")).alias("p"))
    assert g.first().p == "Paris"


def test_first_of_batch(spark):
    df = spark.createDataFrame([(["obs"], {"a": [1, 2], "b": [3]})], "o array<string>, m map<string, array<int>>")
    r = df.select(first_of_batch(F.col("o")).alias("o"), first_of_batch(F.col("m"), "map").alias("m")).first()
    assert r.o == "obs" and r.m == {"a": 1, "b": 3}


def test_encoder_contract(spark):
    def factory():
        return lambda pdf: pd.DataFrame({"subj": pdf.subj, "emb": [[float(len(s)), 1.0] for s in pdf.subj]})
    subj = spark.createDataFrame([("ab",), ("abc",), ("ab",)], "subj string")
    got = {r.subj: r.emb for r in encode_subjects(subj, factory).collect()}
    assert got == {"ab": [2.0, 1.0], "abc": [3.0, 1.0]}


def test_run_config_path_round_trip(spark):
    c = RunConfig(data="TREx", model="bert-large-cased", num_priming_examples=3, priming_type="{} -> {}",
                  use_close_examples=True, random_seed=2)
    df = spark.createDataFrame([("out/" + c.run_path,)], "p string")
    r = df.filter(is_run_path(F.col("p"))).select(*run_key(F.col("p"))).first()
    assert tuple(r) == ("TREx", "bert-large-cased", 3, "rarr", True, 2)


def test_results_table_and_gains_rendering(spark):
    rows = [("TREx", "bert-base-cased", 3, "nl", False, s, 0.2 + 0.1 * s) for s in (0, 1)]
    rows += [("TREx", "bert-base-cased", 0, "nl", False, 0, 0.1)]
    summ = spark.createDataFrame(rows, "data string, model string, num_examples bigint, priming_type string, "
                                       "use_close_examples boolean, random_seed bigint, p_at_1 double")
    cells = rp.results_table(spark, summ)
    total = {r.label: r for r in cells.filter("corpus = 'TREx' AND slice = 'total'").collect()}
    assert np.isclose(total["Bb$^3$"].value, 0.25) and total["Bb$^3$"].n_runs == 2
    assert total["Bl$_{opt}$"].is_best and total["Bb"].value == 0.1
    tex = rp.render_results_table(cells)
    assert "\\textbf{43.9}" in tex and len(tex.splitlines()) == 10
    rel = spark.createDataFrame([("r1", 0, 0.1), ("r1", 1, 0.2), ("r1", 3, 0.3), ("r1", 10, 0.5)],
                                "rel string, num_examples bigint, p_at_1 double")
    rels = spark.createDataFrame([("r1", "[X] in [Y] .", "N-1")], "rel string, template string, type string")
    line = rp.gains_lines(rp.relation_gains(rel, rels)).first().line
    assert line == "r1 & [s] in [o] . & 10.0 & 20.0 & 40.0 \\\\"


def test_display_labels(spark):
    df = spark.createDataFrame([("bert-base-cased",), ("t5-large",)], "m string")
    keep = [r.l for r in df.select(rp.display_label(F.col("m"), rp.MODEL_LABELS).alias("l")).collect()]
    empty = [r.l for r in df.select(rp.display_label(F.col("m"), rp.MODEL_LABELS, "empty").alias("l")).collect()]
    assert keep == ["bert-base", "t5-large"] and empty == ["bert-base", ""]
