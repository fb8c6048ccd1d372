"""Observation and inventory text cleanup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlens.functions.text import WS_CLASS, words

# fixed values: game text markers and the words removed from inventory items
WELCOME = "Welcome to TextWorld! "
NOTHING = "You are carrying nothing."
CARRYING = "You are carrying:"
ARTICLES = ["a", "an", "some", "pair", "of"]


def py_strip(c: Column) -> Column:
    """str.strip(): Python whitespace removed at both ends."""
    return F.regexp_replace(c, f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def clean_observation(obs: Column, description: Column) -> Column:
    """Remove the room description from an observation, then keep what
    follows the welcome banner (stripped) when there is one."""
    o = F.when(F.instr(obs, description) > 0, F.replace(obs, description, F.lit(""))).otherwise(obs)
    return F.when(F.instr(o, WELCOME) > 0, py_strip(F.split_part(o, F.lit(WELCOME), F.lit(2)))).otherwise(o)


def inventory_items(inv: Column) -> Column:
    """Inventory text to item names without articles."""
    body = F.replace(inv, F.lit(CARRYING), F.lit(""))
    items = F.filter(F.transform(F.split(body, "\n "), py_strip), lambda s: F.length(s) > 0)
    items = F.transform(items, lambda s: F.array_join(F.filter(words(s), lambda w: ~w.isin(*ARTICLES)), " "))
    return F.when(inv == NOTHING, F.array().cast("array<string>")).otherwise(items)
