"""Continuation probabilities of candidates by a prefix trie.

Candidates are sequences of subwords.  Those of a group (a scene's containers,
say) form a trie: a node is a prefix, an edge the subword that follows.  The
distribution behind (sentence, prefix) is the same for all candidates that go
through the node, so a scorer is asked once for each distinct prompt of a node
and the answers are joined down the edges.  A node's prompt is that of its
first candidate: sentence, prefix, mask, the candidate's remaining subwords.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.operators.scoring import combine_logits, score_prompts
from factlens.store import persisted


def candidate_trie(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (scene, candidate, sub): edges (scene, candidate, prefix, token) and
    nodes (scene, prefix, rest), rest that of the node's first candidate by name."""
    steps = candidates.select("scene", "candidate", "sub", F.posexplode("sub").alias("pos", "token"))
    edges = steps.select("scene", "candidate", F.slice("sub", F.lit(1), F.col("pos")).alias("prefix"), "token",
                         F.array_join(F.slice("sub", F.col("pos") + 2, F.size("sub")), "").alias("rest"))
    nodes = edges.groupBy("scene", "prefix").agg(F.min_by("rest", "candidate").alias("rest"))
    return edges.drop("rest"), nodes


def node_prompts(sentences: DataFrame, nodes: DataFrame, mask: str) -> DataFrame:
    """(scene, obj, prefix, prompt) of each sentence (scene, obj, sentence) and
    node of its scene; empty parts are dropped, a line end closes the prompt."""
    parts = F.array(F.col("sentence"), F.array_join("prefix", ""), F.lit(mask), F.col("rest"))
    prompt = F.concat(F.array_join(F.filter(parts, lambda s: F.length(s) > 0), " "), F.lit("\n"))
    return sentences.join(nodes, "scene").select("scene", "obj", "prefix", prompt.alias("prompt"))


def token_probs(prompts: DataFrame, scorer_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                wanted: DataFrame) -> DataFrame:
    """(text_key, token, p) for the ``wanted`` (text_key, token): softmax over
    all tokens that the scorer gives for the distinct ``prompts`` (text_key, prompt)."""
    scores = persisted(score_prompts(prompts.dropDuplicates(["text_key"]), scorer_factory, "text_key string, token string, logit double",
                                     "prompt", "text_key"), "scores")
    masses = combine_logits(scores, 0, ("text_key",)).groupBy("text_key").agg(F.collect_list("logit").alias("_l"))  # one a task
    top = F.array_max("_l")
    total = F.log(F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    masses = masses.select("text_key", total.alias("_total"))
    return wanted.distinct().join(scores, ["text_key", "token"]).join(masses, "text_key") \
        .select("text_key", "token", F.exp(F.col("logit") - F.col("_total")).alias("p"))


def continuation_probs(sentences: DataFrame, candidates: DataFrame,
                       scorer_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], mask: str = "<mask>") -> DataFrame:
    """(scene, obj, candidate, prob): a candidate takes the probability of its
    likeliest subword, and an object's candidates are normalised (null if no
    subword of any has a probability)."""
    edges, nodes = candidate_trie(candidates)
    prompts = node_prompts(sentences, nodes, mask).withColumn("text_key", F.sha2("prompt", 256))
    steps = prompts.select("scene", "obj", "prefix", "text_key").join(edges, ["scene", "prefix"])
    p = token_probs(prompts.select("text_key", "prompt"), scorer_factory, steps.select("text_key", "token"))
    best = steps.join(p, ["text_key", "token"], "left").groupBy("scene", "obj", "candidate").agg(
        F.coalesce(F.max("p"), F.lit(0.0)).alias("best"))
    total = F.sum("best").over(Window.partitionBy("scene", "obj"))
    return best.select("scene", "obj", "candidate", F.when(total > 0, F.col("best") / total).alias("prob"))
