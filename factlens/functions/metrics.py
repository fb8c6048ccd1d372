"""Ranking metrics over prediction arrays.

``preds`` is an array of predicted strings in rank order, ``probs`` the
matching probabilities and ``targets`` an array of acceptable answers.
Both sides are lower-cased before comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC_KS = (1, 3, 5, 10, 20)


def _lower_all(c: Column) -> Column:
    return F.transform(c, lambda x: F.lower(x))


def precision_at(preds: Column, targets: Column, k: int, lowered: bool = False) -> Column:
    """True when any target is among the first k predictions
    (``lowered``: ``preds`` is already lower-cased)."""
    p = preds if lowered else _lower_all(preds)
    return F.coalesce(F.arrays_overlap(F.slice(p, 1, k), _lower_all(targets)), F.lit(False))


def reciprocal_rank(preds: Column, targets: Column, lowered: bool = False) -> Column:
    """Max over found targets of 1/(first position); 0 when none is found."""
    p = preds if lowered else _lower_all(preds)
    rr = F.transform(_lower_all(targets), lambda t: F.when(F.array_position(p, t) > 0,
                     F.lit(1.0) / F.array_position(p, t)).otherwise(F.lit(0.0)))
    return F.coalesce(F.array_max(rr), F.lit(0.0))


def target_likelihood(preds: Column, probs: Column, targets: Column, lowered: bool = False) -> Column:
    """Max over found targets of the probability at its first position; else 0."""
    p = preds if lowered else _lower_all(preds)
    lk = F.transform(_lower_all(targets), lambda t: F.when(F.array_position(p, t) > 0,
                     F.element_at(probs, F.array_position(p, t).cast("int"))).otherwise(F.lit(0.0)))
    return F.coalesce(F.array_max(lk), F.lit(0.0))


def single_target_metrics(preds_l: Column, probs: Column, target: Column, ks=METRIC_KS) -> dict:
    """The same metrics for exactly one target, without per-element lambdas
    (``preds_l`` lower-cased; ``target`` a string)."""
    pos = F.array_position(preds_l, F.lower(target))
    return found_metrics(pos, F.element_at(probs, pos.cast("int")), ks)


def found_metrics(pos: Column, prob: Column, ks=METRIC_KS) -> dict:
    """The metrics of a target that is first at ``pos`` (0: not predicted) with
    probability ``prob``."""
    out = {f"p_at_{k}": (pos > 0) & (pos <= k) for k in ks}
    out["mrr"] = F.when(pos > 0, F.lit(1.0) / pos).otherwise(F.lit(0.0))
    out["target_likelihood"] = F.when(pos > 0, prob).otherwise(F.lit(0.0))
    return out
