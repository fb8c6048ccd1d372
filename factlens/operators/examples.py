"""From raw facts to probe examples.

Raw facts carry ``rel, subj, obj, uuid`` (plus anything else); relation
metadata carries ``rel, template, type``.  The steps mirror the order of
the reference: templates are filled, duplicates of (rel, subj, obj) are
dropped keeping the first in load order, and only then are invalid rows
filtered out (a first copy that is invalid removes the fact entirely).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions.text import fill_template, token_count
from factlens.session import bounded_broadcast

MAX_PROMPT_TOKENS = 100
MAX_RELATIONS = 100_000
MAX_VOCAB = 5_000_000
#: Rows that one task sorts at a time where strings are aggregated, and parts of a key's rows.
TASK_ROWS = 500_000
KEY_PARTS = 8


def attach_relations(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Join facts to their relation metadata; an unknown relation is an error."""
    rel = bounded_broadcast(relations.select("rel", "template", "type"), MAX_RELATIONS)
    j = facts.join(rel, "rel", "left")
    return j.withColumn("template", F.when(F.col("template").isNotNull(), F.col("template"))
                        .otherwise(F.raise_error(F.concat(F.lit("unknown relation: "), F.col("rel")))))


def fill_templates(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Probe examples ``uuid, rel, type, subj, y, x`` with ``x`` the filled template."""
    j = attach_relations(facts, relations)
    return j.select("uuid", "rel", "type", "subj", F.col("obj").alias("y"),
                    fill_template(F.col("template"), F.col("subj")).alias("x"))


def first_occurrence(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Keep, per key, the row with the smallest ``order`` value.

    Written as a grouped ``min(struct(order, ...))`` rather than a
    row_number window: the aggregate is combined map-side, so a key that
    holds a third of all rows costs one small partial row per task.

    An aggregate of strings sorts the rows that a task reads, whole files at a
    time; above ``TASK_ROWS`` rows they are dealt into tasks of about so many
    first, a key's rows in up to ``KEY_PARTS`` parts.
    """
    rest = [c for c in cols if c not in keys and c != order]
    best = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_b")
    tasks = math.ceil(df.count() / TASK_ROWS)
    if tasks > 1:
        parted = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(KEY_PARTS)))
        parted = parted.repartition(tasks, *keys, "_part").groupBy(*keys, "_part").agg(best)
        found = parted.repartition(tasks, *keys).groupBy(*keys).agg(F.min("_b").alias("_b"))
    else:
        found = df.groupBy(*keys).agg(best)
    return found.select(
        *keys, F.col("_b._o").alias(order), *[F.col("_b." + c).alias(c) for c in rest])


def dedup_examples(examples: DataFrame) -> DataFrame:
    """First occurrence per (rel, subj, y), load order = uuid."""
    return first_occurrence(examples, ["rel", "subj", "y"], "uuid",
                            [c for c in examples.columns])


def valid_examples(examples: DataFrame, vocab: DataFrame,
                   max_tokens: int = MAX_PROMPT_TOKENS) -> DataFrame:
    """Non-empty answer and subject, prompt of at most ``max_tokens``
    whitespace tokens, answer in the vocabulary (case-sensitive)."""
    ok = (F.coalesce(F.length("y"), F.lit(0)) > 0) & (F.coalesce(F.length("subj"), F.lit(0)) > 0) \
        & (token_count(F.col("x")) <= max_tokens)
    v = bounded_broadcast(vocab.select(F.col("token").alias("y")).distinct(), MAX_VOCAB)
    return examples.filter(ok).join(v, "y", "left_semi")


def other_solutions(raw_facts: DataFrame, examples: DataFrame, relations: DataFrame) -> DataFrame:
    """For N-M relations, the other objects of the same (rel, subj) over all
    raw rows (before de-duplication and filtering), minus the example's own
    answer; empty for other relation types.  Sorted for determinism."""
    nm = bounded_broadcast(relations.filter(F.col("type") == "N-M").select("rel"), MAX_RELATIONS)
    sols = (raw_facts.join(nm, "rel", "left_semi")
            .groupBy("rel", "subj").agg(F.collect_set("obj").alias("_sols")))
    j = examples.join(sols, ["rel", "subj"], "left")
    return j.withColumn("other_solutions", F.array_sort(F.array_except(
        F.coalesce(F.col("_sols"), F.array().cast("array<string>")), F.array(F.col("y"))))).drop("_sols")


def known_answers(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Multi-answer rows (rel, subj, answers) with ``y``, the answers in the
    vocabulary or its lower-cased copy (the answer itself is not lower-cased)
    in list order, and ``solvable``; a row stays even if no answer is left."""
    allowed = vocab.select("token").union(vocab.select(F.lower("token").alias("token"))).distinct().withColumn("_ok", F.lit(True))
    answers = rows.select("rel", "subj", F.posexplode_outer("answers").alias("pos", "a"))
    answers = answers.join(bounded_broadcast(allowed, MAX_VOCAB), F.col("a") == F.col("token"), "left")
    kept = answers.groupBy("rel", "subj").agg(
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("pos", "a")))).alias("_k"))
    out = rows.join(kept, ["rel", "subj"]).withColumn("y", F.col("_k.a")).drop("_k")
    return out.withColumn("solvable", F.size("y") > 0)


def solvable_relations(rows: DataFrame) -> DataFrame:
    """The rows of relations with at least one solvable row."""
    return rows.join(rows.filter("solvable").select("rel").distinct(), "rel", "left_semi")
