"""Metrics per example, per relation and the macro rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions.metrics import (METRIC_KS, found_metrics, precision_at, reciprocal_rank,
                                        single_target_metrics, target_likelihood)
from factlens.session import bounded_broadcast

METRIC_COLS = [f"p_at_{k}" for k in METRIC_KS] + ["mrr", "target_likelihood"]
MAX_RELATIONS = 100_000


def example_metrics(preds: DataFrame, targets_col: str = "targets") -> DataFrame:
    """Adds p_at_k (boolean), mrr and target_likelihood to rows holding
    ``preds, probs`` (or ``found``, the places and probabilities of the targets
    among them) and an array of targets.  Rows without predictions
    (NULL arrays) score 0 everywhere."""
    if "found" in preds.columns:
        return _found_metrics(preds, targets_col)
    lowered = "preds_l" in preds.columns
    p = F.coalesce(F.col("preds_l" if lowered else "preds"), F.array().cast("array<string>"))
    pr = F.coalesce(F.col("probs"), F.array().cast("array<double>"))
    t = F.coalesce(F.col(targets_col), F.array().cast("array<string>"))
    general = {f"p_at_{k}": precision_at(p, t, k, lowered) for k in METRIC_KS}
    general["mrr"] = reciprocal_rank(p, t, lowered)
    general["target_likelihood"] = target_likelihood(p, pr, t, lowered)
    if not lowered:
        return preds.select("*", *[c.alias(n) for n, c in general.items()])
    # one answer (the usual case): position lookups instead of lambdas
    single = single_target_metrics(p, pr, F.get(t, 0))
    one = F.size(t) == 1
    return preds.select("*", *[F.when(one, single[n]).otherwise(general[n]).alias(n) for n in general])


def _found_metrics(rows: DataFrame, targets_col: str) -> DataFrame:
    """``example_metrics`` of rows with ``found`` (pos, 0: not among the
    predictions, and prob of each target; NULL without predictions)."""
    t = F.coalesce(F.col(targets_col), F.array().cast("array<string>"))
    one, hit = F.size(t) == 1, F.get("found", 0)
    # without predictions a target is nowhere, and a NULL one has no place
    pos = F.when(F.col("found").isNotNull(), hit["pos"]).when(F.get(t, 0).isNotNull(), F.lit(0))
    single = found_metrics(pos, hit["prob"])

    def best(name: str) -> F.Column:
        return F.coalesce(F.array_max(F.transform("found", lambda x: found_metrics(x["pos"], x["prob"])[name])), F.lit(0.0))

    def among(k: int) -> F.Column:
        return F.coalesce(F.exists("found", lambda x: (x["pos"] > 0) & (x["pos"] <= k)), F.lit(False))

    general = {f"p_at_{k}": among(k) for k in METRIC_KS} | {n: best(n) for n in ("mrr", "target_likelihood")}
    return rows.select("*", *[F.when(one, single[n]).otherwise(general[n]).alias(n) for n in general])


def relation_metrics(metrics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every metric per (keys..., rel); booleans count as 0/1."""
    aggs = [F.avg(F.col(c).cast("double")).alias(c) for c in METRIC_COLS]
    return metrics.groupBy(*keys, "rel").agg(*aggs, F.count(F.lit(1)).alias("n_examples"))


def macro_rollup(rel_metrics: DataFrame, relations: DataFrame, data: str,
                 keys: tuple[str, ...] = (), by: str = "type") -> DataFrame:
    """Unweighted mean over relations: one total row labelled ``data`` and one
    row per relation type (or per relation, ``by='rel'``) labelled
    ``data_<slice>``.  Never a mean over rows."""
    if by == "type":
        rel = bounded_broadcast(relations.select("rel", "type"), MAX_RELATIONS)
        j = rel_metrics.join(rel, "rel", "left")
    else:
        j = rel_metrics
    aggs = [F.avg(c).alias(c) for c in METRIC_COLS]
    g = j.groupingSets([[*keys, by], [*keys]], *keys, by).agg(
        *aggs, F.count(F.lit(1)).alias("n_relations"), F.grouping(by).alias("_total"))
    label = F.when(F.col("_total") == 1, F.lit(data)).otherwise(
        F.concat(F.lit(data + "_"), F.col(by).cast("string")))
    return g.select(*keys, label.alias("data"), *METRIC_COLS, "n_relations")
