"""A shuffle whose order can be computed: a keyed permutation of row numbers.

Row i of n goes to place ``place(i)`` by a Feistel network over the next power
of two, walked again while it lands outside n (cycle walking), which is a
bijection of 0 ... n-1.  ``row_at`` is its inverse.  So the row at any place,
or the rows of any batch, are found by an equi-join on a computed number: no
sort by a random key, nothing to keep, and the same order on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.hashing import h32
from factlens.operators.indexing import group_index, spread_work

ROUNDS = 6
#: a walk leaves n with a chance under 1/2 a step
WALK = 128
#: batches of at most so many row numbers are broadcast
MAX_BATCH = 1_000_000


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and right half of numbers below n (n >= 1)."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: Column, n: int, key: int, rounds) -> Column:
    """One pass: every round changes one half by a hash of the other."""
    left_bits, right_bits = halves(n)

    def turn(r: int, half: Column, bits: int) -> Column:
        return h32(F.lit(key), F.lit(r), half).bitwiseAND(F.lit((1 << bits) - 1))

    def step(r: int):
        if r % 2 == 0:
            return lambda s: F.struct(s["l"].bitwiseXOR(turn(r, s["r"], left_bits)).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), s["r"].bitwiseXOR(turn(r, s["l"], right_bits)).alias("r"))

    state = F.struct(F.shiftright(x, right_bits).alias("l"), x.bitwiseAND(F.lit((1 << right_bits) - 1)).alias("r"))
    for r in rounds:
        # a lambda's argument is a value, so a half isn't computed anew for each of its uses
        state = F.transform(F.array(state), step(r))[0]
    return F.transform(F.array(state), lambda s: F.shiftleft(s["l"], right_bits).bitwiseOR(s["r"]))[0]


def _walk(x: Column, n: int, key: int, rounds) -> Column:
    at = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _network(x.cast("bigint"), n, key, rounds),
                     lambda s, _: F.when(s >= n, _network(s, n, key, rounds)).otherwise(s))
    return F.transform(F.array(at), lambda y: F.when(y < n, y).otherwise(
        F.raise_error(F.lit("the walk is longer than WALK")).cast("bigint")))[0]


def place(i: Column, n: int, key: int = 0) -> Column:
    """Place of row i (0 <= i < n) in the shuffle ``key`` of n rows."""
    return _walk(i, n, key, range(ROUNDS))


def row_at(place_: Column, n: int, key: int = 0) -> Column:
    """The row at a place of the shuffle."""
    return _walk(place_, n, key, range(ROUNDS - 1, -1, -1))


def shuffled(df: DataFrame, order: list[str], key: int = 0, batch_rows: int | None = None) -> DataFrame:
    """``df`` with ``place`` (0, 1, ... in shuffled order) and, for
    ``batch_rows``, ``batch``.  ``order`` tells rows apart."""
    rows = group_index(df.withColumn("_all", F.lit(0)), ["_all"], order, "_i").drop("_all")
    n = rows.count()
    out = spread_work(rows, n, "_i").withColumn("place", place(F.col("_i"), max(n, 1), key)).drop("_i")
    return out if batch_rows is None else out.withColumn("batch", F.floor(F.col("place") / batch_rows).cast("bigint"))


def batch_of(df: DataFrame, index: str, n: int, batch: int, batch_rows: int, key: int = 0) -> DataFrame:
    """The rows of one batch of n numbered rows (column ``index``), in order:
    their numbers are computed, so only they are looked up."""
    first, last = batch * batch_rows, min(n, (batch + 1) * batch_rows)
    wanted = df.sparkSession.range(first, last).select(F.col("id").alias("place"))
    wanted = wanted.select("place", row_at(F.col("place"), n, key).alias(index))
    return df.join(F.broadcast(wanted), index) if batch_rows <= MAX_BATCH else df.join(wanted, index)
