"""Deterministic draws.

Every random choice of the reference (numpy, unseeded or seeded once) is
replaced by a hash of (seed, row identity, slot): the result depends only
on those values, not on partitioning, file order or retries.  The hash is
the first 32 bits of MD5, which any SQL engine can reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(c):
    return F.col(c) if isinstance(c, str) else c


def h32(*parts) -> Column:
    """Unsigned 32-bit hash of the '|'-joined string parts (BIGINT)."""
    s = F.concat_ws("|", *[_as_col(p).cast("string") for p in parts]) if len(parts) > 1 \
        else _as_col(parts[0]).cast("string")
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def xor(a, b):
    """Bitwise XOR of two columns, or of two NumPy arrays."""
    return a.bitwiseXOR(b) if isinstance(a, Column) else a ^ b


def unit_draw(*parts) -> Column:
    """Uniform number in [0, 1) from the hash of the parts."""
    return h32(*parts) / F.lit(TWO_POW_32)


def draw_index(n: Column, *parts) -> Column:
    """Uniform integer in [0, n) from the hash of the parts (NULL if n <= 0)."""
    return F.when(n > 0, F.pmod(h32(*parts), n))
