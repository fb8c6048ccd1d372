"""Parsers for the reference's text encodings: run paths, Python list
literals and key:value log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: run file name layout and the legacy priming names
RUN_PATH_PATTERN = r"^(?:.*/)?([^/]+)/([^/]+)/pe-([0-9]+)_nl-([^_/]+)_ce-(True|False)_rs-([0-9]+)\.csv$"
LEGACY_PRIMING = {"True": "nl", "nl": "nl", "False": "rarr", "rarr": "rarr", "Rarr": "Rarr", "par": "par"}


def is_run_path(path: Column) -> Column:
    """Whole-path match: anything else in a results folder (a summary file,
    a note) is not a run."""
    return path.rlike(RUN_PATH_PATTERN)


def run_key(path: Column) -> list[Column]:
    """data, model, num_examples, priming_type, use_close_examples, random_seed."""
    g = lambda i: F.regexp_extract(path, RUN_PATH_PATTERN, i)
    nl = g(4)
    prim = None
    for k, v in LEGACY_PRIMING.items():
        prim = F.when(nl == k, F.lit(v)) if prim is None else prim.when(nl == k, F.lit(v))
    prim = prim.otherwise(F.raise_error(F.concat(F.lit("unknown priming type in run path: "), path)))
    return [g(1).alias("data"), g(2).alias("model"), g(3).cast("bigint").alias("num_examples"),
            prim.alias("priming_type"), (g(5) == "True").alias("use_close_examples"),
            g(6).cast("bigint").alias("random_seed")]


def parse_list_literal(literal: Column, element_type: str = "string") -> Column:
    """A Python list repr ("['a', \"b's\"]", "[0.5, 2e-05]") to an array.

    Single quotes and backslash escapes are accepted; a literal that is not
    valid (e.g. a non-JSON escape) parses to NULL, which callers count.
    """
    return F.from_json(literal, f"array<{element_type}>",
                       {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true",
                        "allowNonNumericNumbers": "true"})


def python_repr(s: Column) -> Column:
    """repr() of a string: single quotes unless it holds a single quote and
    no double quote; backslashes and the chosen quote escaped."""
    dq = s.contains("'") & ~s.contains('"')
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def render_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, python_repr), ", "), F.lit("]"))


def parse_kv_line(line: Column) -> Column:
    """'k1:v1,k2:v2' to a map (values may not contain ',' or ':')."""
    return F.str_to_map(line, F.lit(","), F.lit(":"))


def first_of_batch(c: Column, kind: str = "array") -> Column:
    """Batch-of-one unwrapping: the first element of an array, or, for a map
    of arrays, the map of first elements."""
    if kind == "array":
        return F.get(c, 0)
    if kind == "map":
        return F.transform_values(c, lambda k, v: F.get(v, 0))
    raise ValueError("kind must be 'array' or 'map'")
