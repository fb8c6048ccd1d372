"""Admissible-command handling, as array expressions on one row each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlens.functions.hashing import h32

# fixed values: commands dropped outright and command prefixes dropped
DROP_EXACT = ["look", "inventory"]
DROP_PREFIXES = ["close", "drop", "open"]


def useful_commands(cmds: Column) -> Column:
    """Drop 'examine' commands except for the cookbook, 'look' and
    'inventory', and anything starting with close/drop/open."""
    def keep(c):
        ok = (~c.contains("examine")) | c.contains("cookbook")
        ok = ok & ~c.isin(*DROP_EXACT)
        for p in DROP_PREFIXES:
            ok = ok & ~c.startswith(p)
        return ok
    return F.filter(cmds, keep)


def cap_commands(cmds: Column, k: int, seed: int, *ident) -> Column:
    """At most k commands drawn without replacement (hash order of the
    positions); lists of k or fewer are returned unchanged."""
    keyed = F.transform(cmds, lambda c, j: F.struct(h32(F.lit(seed), *ident, j).alias("h"), j.alias("j"), c.alias("c")))
    drawn = F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["c"])
    return F.when(F.size(cmds) > k, drawn).otherwise(cmds)


def take_choices(cmds: Column, stored: Column) -> Column:
    """'take' commands whose part before 'from' names no stored object."""
    return F.filter(cmds, lambda c: c.startswith("take") & ~F.exists(
        stored, lambda o: F.split_part(c, F.lit("from"), F.lit(1)).contains(o)))


def first_mentioning(cmds: Column, name: Column) -> Column:
    """First command containing ``name`` (NULL if none)."""
    return F.get(F.filter(cmds, lambda c: c.contains(name)), 0)


def uniform_pick(arr: Column, seed: int, *ident) -> Column:
    """One element chosen by hash (NULL for an empty array)."""
    n = F.size(arr)
    return F.when(n > 0, F.get(arr, F.pmod(h32(F.lit(seed), *ident), n).cast("int")))
