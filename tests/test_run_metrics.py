import math

from pyspark.sql import functions as F

from factlens.operators import runs as rn


def test_examples_without_predictions_score_zero_in_every_run(spark):
    configs = [("m", 0, "nl", False, 0), ("m", 3, "nl", False, 0)]
    preds = spark.createDataFrame([(r, 1, ["A"], ["a"], [1.0]) for r in (0, 1)],
                                  "run_id bigint, eid bigint, preds array<string>, preds_l array<string>, probs array<double>")
    ex = spark.createDataFrame([(1, "u1", "r", "A"), (2, "u2", "q", "B")], "eid bigint, uuid string, rel string, y string")
    m = rn.run_metrics(preds, ex, F.array("y"), configs)
    got = {(r.uuid, r.num_examples): (r.p_at_1, r.mrr, r.target_likelihood) for r in m.collect()}
    assert got == {("u1", 0): (True, 1.0, 1.0), ("u1", 3): (True, 1.0, 1.0), ("u2", 0): (False, 0.0, 0.0), ("u2", 3): (False, 0.0, 0.0)}


def test_predictions_of_all_runs_keep_their_example_without_a_shuffle(spark):
    configs = [("m", k, "nl", False, 0) for k in (0, 3)]
    examples = spark.createDataFrame([(i, f"u{i}", "r" if i % 3 else "none", [f"t{i % 5}"]) for i in range(40)],
                                     "eid long, uuid string, rel string, targets array<string>")
    cands = spark.createDataFrame([("r", f"t{i}", i + 1) for i in range(30)] + [("r", "out", 99)], "rel string, token string, cnt long")
    vocab = spark.createDataFrame([(f"t{i}",) for i in range(30)], "token string")
    preds = rn.run_predictions(examples, cands, vocab, configs, lambda of: of("cnt") * (of("_k") + 1.0) * of("_one"),
                               {"_k": lambda c: float(c[1])}, k=4, example_cols={"_one": F.lit(1.0)})
    rows = preds.collect()
    assert len(rows) == 26 * 2 + 14
    for r in rows:
        assert r.uuid == f"u{r.eid}" and r.targets == [f"t{r.eid % 5}"]
        if r.rel == "none":
            assert r.run_id is None and r.preds is None
            continue
        step = configs[r.run_id][1] + 1.0
        z = sum(math.exp(step * (i - 30)) for i in range(1, 31))
        assert r.preds == ["t29", "t28", "t27", "t26"]
        assert all(abs(p - math.exp(-step * i) / z) < 1e-12 for i, p in enumerate(r.probs))
    m = rn.metrics_of_runs(preds, configs)
    assert m.count() == 80 and m.filter("mrr > 0").count() == 0
    # the examples are dealt out once, and nothing of (examples x runs) rows moves or leaves the JVM
    plan = m.select("uuid", "mrr")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "eid#" in line]
    assert len(moved) == 1 and "SortMergeJoin" not in plan and "MapInArrow" not in plan


def test_predictions_of_candidates_too_many_to_send_are_the_same(spark, monkeypatch):
    configs = [("m", 0, "nl", False, 0)]
    examples = spark.createDataFrame([(1, "a", "r"), (2, "b", "none")], "eid long, uuid string, rel string")
    cands = spark.createDataFrame([("r", "x", 1), ("r", "y", 5)], "rel string, token string, cnt long")
    vocab = cands.select("token")
    monkeypatch.setattr(rn, "MAX_CANDIDATES", 0)
    got = {r.uuid: (r.run_id, r.preds) for r in rn.run_predictions(examples, cands, vocab, configs, lambda of: of("cnt") * 1.0).collect()}
    assert got == {"a": (0, ["y", "x"]), "b": (None, None)}
