"""String helpers shared by prompt construction and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() separators: ASCII controls \t \n \v \f \r, the
# separators \x1c-\x1f and \x85, and every Unicode space separator (Z*).
WS_CLASS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
TOKEN_PATTERN = "[^" + WS_CLASS + "]+"


def token_count(c: Column) -> Column:
    """Number of whitespace-separated tokens, as ``len(s.split())``."""
    return F.regexp_count(c, F.lit(TOKEN_PATTERN))


def words(c: Column) -> Column:
    """Whitespace tokens of a string, as ``s.split()``."""
    return F.regexp_extract_all(c, F.lit("(" + TOKEN_PATTERN + ")"), 1)


def fill_template(template: Column, subj: Column, mask: str = "[MASK]") -> Column:
    """Replace every ``[X]`` by the subject, then every ``[Y]`` by the mask.

    Literal replacement (no regex), in that order: a subject that itself
    contains ``[Y]`` gets masked too, exactly like two str.replace calls.
    """
    return F.replace(F.replace(template, F.lit("[X]"), subj), F.lit("[Y]"), F.lit(mask))
