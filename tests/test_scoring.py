import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from factlens.operators import scoring as sc


def test_softmax_over_allowed_tokens_and_ties(spark):
    logits = spark.createDataFrame([
        ("e1", "a", 2.0), ("e1", "b", 2.0), ("e1", "c", 1.0), ("e1", "zz", 50.0),   # zz not allowed
        ("e2", "zz", 1.0),                                                         # nothing allowed
        ("e3", "a", 1000.0), ("e3", "b", 999.0),                                   # large logits
    ], "uuid string, token string, logit double")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",)], "token string")
    top = sc.masked_topk(logits, vocab, k=2)
    rows = {(r.uuid, r.rank): r for r in top.collect()}
    assert [rows[("e1", 1)].token, rows[("e1", 2)].token] == ["a", "b"]          # tie -> token order
    z = 2 * math.exp(2.0) + math.exp(1.0)
    assert abs(rows[("e1", 1)].prob - math.exp(2.0) / z) < 1e-12
    assert ("e2", 1) not in rows                                                   # fewer than k: no padding
    assert abs(rows[("e3", 1)].prob - 1 / (1 + math.exp(-1))) < 1e-12
    full = sc.masked_topk(logits, vocab, k=10).groupBy("uuid").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in full)


def test_prediction_arrays_in_rank_order(spark):
    top = spark.createDataFrame([("e", 2, "b", 0.3), ("e", 1, "a", 0.7)], "uuid string, rank int, token string, prob double")
    r = sc.prediction_arrays(top).first()
    assert r.preds == ["a", "b"] and r.probs == [0.7, 0.3]


def test_score_prompts_calls_factory_per_task(spark):
    def factory():
        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = [(u, t, float(len(x)) if t == "long" else 0.0) for u, x in zip(pdf.uuid, pdf.x_primed)
                    for t in ("long", "short")]
            return pd.DataFrame(rows, columns=["uuid", "token", "logit"])
        return score
    prompts = spark.createDataFrame([("u1", "abc"), ("u2", "a")], "uuid string, x_primed string").repartition(2)
    out = sc.score_prompts(prompts, factory)
    got = {(r.uuid, r.token): r.logit for r in out.collect()}
    assert got[("u1", "long")] == 3.0 and got[("u2", "short")] == 0.0 and len(got) == 4


def _brute_topk(rows, k):
    by = {}
    for u, t, x in rows:
        by.setdefault(u, []).append((-x, t))
    out = {}
    for u, c in by.items():
        m = -min(c)[0]
        z = sum(math.exp(-x - m) for x, _ in c)
        out[u] = [(t, math.exp(-x - m) / z) for x, t in sorted(c)[:k]]
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for u, lst in want.items():
        assert [t for t, _ in got[u]] == [t for t, _ in lst]
        assert np.allclose([p for _, p in got[u]], [p for _, p in lst], rtol=1e-12, atol=1e-300)


def _logits(seed=1, n=4000):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["b", "c", "d", None]), f"é{i}" if i % 3 else f"Z{i}", float(rng.randrange(-9, 9)) * 30) for i in range(n)]
    return rows + [("one", "x", -1e308), ("deep", "a", 0.0), ("deep", "b", -5000.0)]


def test_one_pass_topk_over_many_parts(spark, monkeypatch):
    rows = _logits()
    df = spark.createDataFrame(rows, "uuid string, token string, logit double").repartition(5)
    want = _brute_topk(rows, 7)
    parts = sc.combine_logits(df, 7, ("uuid",))
    assert parts.count() <= 6 * 8 * 5
    again = sc.combine_logits(parts.filter("token is not null"), 7, ("uuid",))
    assert {r.uuid for r in again.collect()} == want.keys()
    for combined in (df, df.coalesce(1)):
        got = {r.uuid: list(zip(r.preds, r.probs, strict=True)) for r in sc.topk_arrays(combined, None, 7).collect()}
        _same(got, want)
    plan = sc.masked_topk(df, None, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Window" not in plan


def test_topk_in_place_equals_one_pass(spark, monkeypatch):
    rows = sorted(_logits(3), key=lambda r: r[0] or "")
    rows = [(i % 3, u, t, x) for i, (u, t, x) in enumerate(rows) if u]
    want = _brute_topk([((r, u), t, x) for r, u, t, x in rows], 6)
    df = spark.createDataFrame(rows, "run_id long, uuid string, token string, logit double").coalesce(1)

    def got():
        return {(r.run_id, r.uuid): list(zip(r.preds, r.probs, strict=True))
                for r in sc.placed_topk_arrays(df, "uuid", 6, ("run_id", "uuid")).collect()}

    _same(got(), want)
    ranked = sc._Ranked(pa.Table.from_pylist([{"u": "a", "token": t, "logit": x} for t, x in (("p", 1.0), ("q", 3.0), ("r", 2.0), (None, 0.5))]), ("u",), 2)
    assert ranked.combined().column("token").to_pylist() == ["q", "r", None]
    assert abs(ranked.combined().column("logit")[2].as_py() - math.log(math.exp(1) + math.exp(0.5))) < 1e-12
