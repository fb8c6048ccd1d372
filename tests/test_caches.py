import os
import tempfile

import numpy as np
import pandas as pd

from factlens.operators import caches as cc
from factlens.operators import neighbours as nb


def _root():
    return tempfile.mkdtemp(prefix="cache-", dir=os.environ.get("TMPDIR", "/tmp"))


def test_scores_are_made_once_for_each_text(spark):
    root, log = _root() + "/scores", _root()

    def scorer():
        def score(pdf):
            with open(f"{log}/{os.getpid()}-{id(pdf)}", "a") as f:
                f.writelines(t + "\n" for t in pdf["x_primed"])
            rows = [(k, w, float(len(w))) for k, t in zip(pdf["text_key"], pdf["x_primed"], strict=True) for w in t.split()]
            return pd.DataFrame(rows, columns=["text_key", "token", "logit"])
        return score

    def scored():
        return sorted(x.strip("\n") for f in os.listdir(log) for x in open(f"{log}/{f}"))

    one = spark.createDataFrame([("u1", "a bb"), ("u2", "a bb"), ("u3", ""), ("u4", "ccc")], "uuid string, x_primed string")
    got = sorted(tuple(r) for r in cc.cached_scores(one, root, scorer).collect())
    assert got == [("u1", "a", 1.0), ("u1", "bb", 2.0), ("u2", "a", 1.0), ("u2", "bb", 2.0), ("u4", "ccc", 3.0)]
    assert scored() == ["", "a bb", "ccc"]
    two = one.union(spark.createDataFrame([("u5", "dddd ccc"), ("u6", "ccc")], one.schema))
    got = {r["uuid"] for r in cc.cached_scores(two, root, scorer).collect()}
    assert got == {"u1", "u2", "u4", "u5", "u6"} and scored() == ["", "a bb", "ccc", "dddd ccc"]
    assert len(cc.parts(spark, root)) == 2


def test_neighbour_cache_grows_with_its_subjects(spark):
    vecs = np.random.default_rng(0).normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    root = _root() + "/near"

    def rows(x):
        return sorted((r["i"], r["rank"], r["j"], round(r["sim"], 9)) for r in x.collect())

    assert rows(cc.cached_topk(df.filter("id < 50"), root, k=5)) == rows(nb.projection_topk(df.filter("id < 50"), k=5))
    assert rows(cc.cached_topk(df, root, k=5)) == rows(nb.projection_topk(df, k=5))
    assert rows(cc.cached_topk(df.filter("id < 10"), root, k=5)) == rows(nb.projection_topk(df, k=5))
    assert len(cc.parts(spark, root)) == 2
