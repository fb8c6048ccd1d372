"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow of documents in shuffled order, repeated in a new order
(an epoch) as often as ``most`` allows.  A copy's virtual finish time is the
words that its source has given up to its end, divided by the source's target.
The document in service when its source reaches the target is split there,
so a packet ends at time 1.  All packets are range-sorted by finish time and
the mix is truncated where its running total reaches the budget: every source
is served in proportion to its target at any time of the mix.

Targets: sources in the order of their code points (null last) have
``weights`` in turn and share ``share`` times all words by weight; a target
stops at ``most`` times its source's words, and what is above goes to the
others by weight until none is above.  That is one water level for all open
sources: of the levels that follow from closing the first k sources (by words
for each weight), the highest.

Only DataFrame functions are used; words are counted once, all later steps
move a few numbers for each copy.  No step has a window over a whole source:
order numbers and running totals are those of ``running_totals``.

Results: null texts have no words, and a document without words is in the mix
with none.  A null source is a source.  The order is drawn from the ids, so
runs agree; rows that repeat an id are told apart by their place in the files,
and rows alike in all columns may trade places.  A table without words has
targets of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm.common import written
from factlens.llm.running import running_totals
from factlens.session import bounded_broadcast

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 20
MAX_SOURCES = 1_000_000


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, id, source, size): one row for each document, counted once."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                               F.col(source).alias("source"), n.alias("size")), "sizes")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(n, source, weight, source_size, target) for each source, n from 0."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = running_totals(sources, [], [F.asc_nulls_last("source")], {"n": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight), "sources")
    in_turn = [F.asc(F.col("source_size") / F.col("weight")), F.asc("n")]
    counts = [(F.col("n") % len(weights) == k).cast("int") for k in range(len(weights))]
    closed = running_totals(sources, [], in_turn, {"words": F.col("source_size"), **{f"n{k}": c for k, c in enumerate(counts)}})
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    gone = sum((F.col(f"n{k}") * float(w) for k, w in enumerate(weights)), F.lit(0.0))
    level = closed.agg(F.max((F.lit(share * whole["words"]) - F.col("words") * float(most)) / (F.lit(whole["weight"]) - gone))).first()[0]
    target = F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(float(level or 0.0)))
    return written(sources.select("n", "source", "weight", "source_size", target.alias("target")), "targets")


def schedule(sized: DataFrame, wanted: DataFrame, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The packets in question: row, id, n, size, source_size, target, epoch,
    finish (virtual time), words, place (words of the mix before it, in order
    of finish) and taken (words that the mix takes of it)."""
    small = bounded_broadcast(wanted, MAX_SOURCES)
    known = sized.join(small.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source", "weight")
    rounds = F.sequence(F.lit(0), F.least(F.lit(math.ceil(most) - 1), F.greatest(
        F.lit(0), (F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))) - 1).cast("int"))))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("id").cast("string")))
    copies = known.withColumn("epoch", F.explode(rounds)) \
        .withColumn("draw", F.conv(F.substring(draw, 1, 15), 16, 10).cast("bigint"))
    served = running_totals(copies, ["n"], [F.asc("epoch"), F.asc("draw"), F.asc("row")], {"start": F.col("size")})
    first = F.least(F.col("size"), F.greatest(F.floor("target") - F.col("start"), F.lit(0)))
    split = F.when((first > 0) & (first < F.col("size")), F.array(first, F.col("size") - first)).otherwise(F.array("size"))
    packets = served.select("*", F.posexplode(split).alias("half", "words"))
    end = F.when(F.col("half") == 0, F.col("start") + F.col("words")).otherwise(F.col("start") + F.col("size"))
    packets = packets.withColumn("finish", F.when(F.col("target") > 0, end / F.col("target")).otherwise(0.0)).drop("start", "half")
    order = [F.asc(c) for c in ("finish", "n", "epoch", "draw", "row")]
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    placed = running_totals(packets, [], order, {"place": F.col("words")})
    taken = F.least(F.col("words"), F.greatest(F.lit(math.floor(share * budget)) - F.col("place"), F.lit(0)))
    return placed.withColumn("taken", taken).drop("draw")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken) for each document: the words
    that the mix takes of it, repeats counted."""
    sized = sizes(docs, doc_id, text, source)
    packets = schedule(sized, targets(sized, weights, share, most), share, most, seed)
    return packets.groupBy("row", "id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row")
