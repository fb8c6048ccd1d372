import hashlib
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlens.functions.hashing import h32
from factlens.functions.metrics import precision_at, reciprocal_rank, target_likelihood
from factlens.functions.text import fill_template, token_count, words

SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", " ", "　"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SPACES), st.text(string.ascii_letters + "éß.,", min_size=1, max_size=4)),
                max_size=12))
def test_token_count_matches_python_split(spark, parts):
    s = "".join(parts)
    r = spark.createDataFrame([(s,)], "s string").select(token_count(F.col("s")).alias("n"),
                                                         words(F.col("s")).alias("w")).first()
    assert r.n == len(s.split())
    assert r.w == s.split()


def test_fill_template_order(spark):
    df = spark.createDataFrame([("[X] and [X] is in [Y] .", "a [Y] b")], "t string, s string")
    x = df.select(fill_template(F.col("t"), F.col("s")).alias("x")).first().x
    assert x == "[X] and [X] is in [Y] .".replace("[X]", "a [Y] b").replace("[Y]", "[MASK]")


def test_h32_matches_md5(spark):
    r = spark.createDataFrame([("uuid_1", "tok", 3)], "a string, b string, c int").select(
        h32("a", "b", "c").alias("h"), h32(F.col("a")).alias("h1")).first()
    assert r.h == int(hashlib.md5(b"uuid_1|tok|3").hexdigest()[:8], 16)
    assert r.h1 == int(hashlib.md5(b"uuid_1").hexdigest()[:8], 16)


def _ref_metrics(targets, preds, probs, k):
    t = [x.lower() for x in targets]
    p = [x.lower() for x in preds]
    pk = any(x in p[:k] for x in t)
    mrr = max([1.0 / (p.index(x) + 1) for x in t if x in p], default=0.0)
    lik = max([probs[p.index(x)] for x in t if x in p], default=0.0)
    return pk, mrr, lik


CASES = [
    (["Paris"], ["Paris", "London"], [0.6, 0.4]),
    (["paris"], ["London", "x", "PARIS"], [0.5, 0.3, 0.2]),
    (["a"], [f"t{i}" for i in range(19)] + ["a"], [0.05] * 20),
    (["zz"], ["a", "b"], [0.9, 0.1]),
    (["b", "c"], ["c", "a", "b"], [0.5, 0.3, 0.2]),
    ([], ["a"], [1.0]),
    (["A"], ["a", "A"], [0.7, 0.3]),
]


def test_metrics_match_reference_rule(spark):
    df = spark.createDataFrame(CASES, "t array<string>, p array<string>, q array<double>")
    for k in (1, 3, 5, 10, 20):
        rows = df.select(precision_at(F.col("p"), F.col("t"), k).alias("pk"),
                         reciprocal_rank(F.col("p"), F.col("t")).alias("mrr"),
                         target_likelihood(F.col("p"), F.col("q"), F.col("t")).alias("lik")).collect()
        for (t, p, q), r in zip(CASES, rows):
            pk, mrr, lik = _ref_metrics(t, p, q, k)
            assert r.pk == pk and abs(r.mrr - mrr) < 1e-12 and abs(r.lik - lik) < 1e-12


def test_metric_monotonicity(spark):
    df = spark.createDataFrame(CASES, "t array<string>, p array<string>, q array<double>")
    for r in df.select(*[precision_at(F.col("p"), F.col("t"), k).alias(f"p{k}") for k in (1, 3, 5, 10, 20)],
                       reciprocal_rank(F.col("p"), F.col("t")).alias("mrr")).collect():
        assert r.p1 <= r.p3 <= r.p5 <= r.p10 <= r.p20
        assert float(r.p1) <= r.mrr <= float(r.p20)
