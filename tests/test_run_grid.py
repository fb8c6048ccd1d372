"""The run grid's ranking on arrays against brute force, and what is drawn from it."""

import math
import random

from pyspark.sql import functions as F

from factlens.functions.hashing import xor
from factlens.operators import evaluation as ev
from factlens.operators import runs as rn

CONFIGS = [("m", k, "nl", False, 0) for k in (0, 3)]


def tables(spark, wide):
    rng = random.Random(wide)
    cands = [("r", f"{'tT'[i % 2]}{i // 2:03d}", rng.randrange(4), rng.randrange(8)) for i in range(wide)] + [("q", "only", 1, 2), (None, "t000", 1, 1)]
    rows = [(i, f"u{i}", rng.choice(["r", "r", "q", "none", None]), rng.choice([None, *range(16)]),
             [rng.choice(["T000", "t001", "only", "gone", "", None]) for _ in range(rng.randrange(4))]) for i in range(60)]
    rows[0] = (0, None, "r", 3, None)
    return rows, cands, (spark.createDataFrame(rows, "eid long, uuid string, rel string, he long, targets array<string>"),
                         spark.createDataFrame(cands, "rel string, token string, cnt long, ht long"))


def predictions(spark, examples, cands, lists, k=4):
    def logit(of):
        return of("cnt") * (of("_k") + 1.0) + xor(of("_he"), of("_ht")) / 16.0

    e = examples.select("eid", "uuid", "rel", "targets", "he")
    return rn.run_predictions(e, cands, cands.select("token"), CONFIGS, logit, {"_k": lambda c: float(c[1])}, k=k,
                              example_cols={"_he": F.col("he")}, candidate_cols={"_ht": F.col("ht")}, lists=lists)


def test_ranking_with_ties_and_nulls_is_that_of_sorted_lists(spark):
    for wide in (5, 30):
        rows, cands, (e, c) = tables(spark, wide)
        got = {(r.eid, r.run_id): r for r in predictions(spark, e, c, True).collect()}
        want = 0
        for eid, uuid, rel, he, targets in rows:
            mine = [x for x in cands if x[0] == rel and rel is not None]
            if not mine:
                assert got[eid, None].preds is None and got[eid, None].probs is None
                want += 1
            for run in range(2) if mine else ():
                by = sorted((0 if he is None else -(n * (CONFIGS[run][1] + 1.0) + (he ^ ht) / 16.0), t) for _, t, n, ht in mine)
                r, want = got[eid, run], want + 1
                assert r.preds == [t for _, t in by][:4] and r.preds_l == [t.lower() for t in r.preds]
                assert r.uuid == uuid and r.targets == targets
                z = sum(math.exp(-d) for d, _ in by)
                assert r.probs == [None] * len(r.preds) if he is None else all(abs(p - math.exp(-d) / z) < 1e-12 for p, (d, _) in zip(r.probs, by))
        assert len(got) == want


def test_metrics_from_places_are_those_from_lists(spark):
    for wide in (5, 30):
        _, _, (e, c) = tables(spark, wide)
        both = [{(r.eid, r.num_examples): [r[m] for m in ev.METRIC_COLS] for r in rn.metrics_of_runs(predictions(spark, e, c, lists), CONFIGS).collect()}
                for lists in (True, False)]
        assert len(both[0]) == 120 and both[0] == both[1]


def test_the_grid_sorts_no_lists_in_lambdas(spark):
    _, _, (e, c) = tables(spark, 5)
    plan = rn.metrics_of_runs(predictions(spark, e, c, False), CONFIGS)._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "preds" not in plan
