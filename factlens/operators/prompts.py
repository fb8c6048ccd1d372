"""Prompt text operators: relation-specific sentences, scorer preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlens.functions.text import words

MASK = "[MASK]"
MAX_SCORER_TOKENS = 500


def sentence_by_suffix(pred: Column, subj: Column, templates: list[tuple[str, str]]) -> Column:
    """Cloze sentence chosen by the last '/' part of a path-like predicate;
    an unknown suffix is an error."""
    suffix = F.element_at(F.split(pred, "/"), -1)
    expr = None
    for name, tpl in templates:
        a, b = tpl.split("{}")
        val = F.concat(F.lit(a), subj, F.lit(b))
        expr = F.when(suffix == name, val) if expr is None else expr.when(suffix == name, val)
    return expr.otherwise(F.raise_error(F.concat(F.lit("unknown predicate: "), pred)))


def relation_label(pred: Column) -> Column:
    """Slice label of a path-like relation: last '/' part, '_' -> '-'."""
    return F.replace(F.element_at(F.split(pred, "/"), -1), F.lit("_"), F.lit("-"))


def for_mask_model(x: Column, mask_token: str) -> Column:
    """Replace every [MASK] by the scorer's mask token; a prompt without a
    mask is an error."""
    return F.when(F.instr(x, MASK) > 0, F.replace(x, F.lit(MASK), F.lit(mask_token))).otherwise(
        F.raise_error(F.concat(F.lit("no mask in prompt: "), x)))


def for_left_to_right_model(x: Column) -> Column:
    """Text before the first [MASK], stripped (scorers without a mask token)."""
    return F.trim(F.substring_index(x, MASK, 1))


def keep_last_tokens(tokens: Column, n: int = MAX_SCORER_TOKENS) -> Column:
    """Left truncation: the last n tokens."""
    return F.slice(tokens, F.greatest(F.size(tokens) - (n - 1), F.lit(1)), n)


def first_position(tokens: Column, token: str) -> Column:
    """1-based position of the first occurrence, NULL when absent."""
    p = F.array_position(tokens, F.lit(token))
    return F.when(p > 0, p)


def whitespace_tokens(x: Column) -> Column:
    return words(x)


def generated_prediction(text: Column) -> Column:
    """Prediction of a generation model: the text before the first '.',
    stripped (its probability is not known: callers store NULL)."""
    return F.trim(F.substring_index(text, ".", 1))
