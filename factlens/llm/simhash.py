"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming bound.

Fingerprint: lower-cased ASCII, words between blanks, shingles of ``shingle``
words (all words where there are fewer); XXH64 (seed 42) of each shingle's
UTF-8 text; a bit is 1 if it is 1 in over half of the hashes.  Texts without
words (null, empty) have fingerprint 0 and are linked like any other.

Linking by the generalised pigeonhole: the 64 bits are dealt to two
partitions so that correlated bits meet; thresholds t1 + t2 = bound - 1 (-1:
not probed) are allocated by dynamic programming on the number of signatures
to probe and the candidates expected from the bits' frequencies.  Any two
fingerprints within the bound are within t_i on some partition i.  Each
distinct fingerprint probes, for each partition, every value within t_i of
its own, and candidates are verified on all 64 bits.

Only distinct fingerprints are linked, so exact copies cost nothing.  A
partition value that over ``HOT`` fingerprints share (one large group of
near copies) isn't verified pair by pair: its members and probes meet at
shared values of the other bits, one at most floor and the other at most ceil
of half of what is left of the bound away; each value names one member of the
nearer kind and the others link to that one.  Such links are within the bound
too and connect the same fingerprints, and their number grows with the
members, not with the pairs.  Components are the smallest ids reachable.

Results: one row for each input row; rows with a null id are linked like any
other and named by the smallest id that isn't null, or null.
"""

from __future__ import annotations

import itertools
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factlens.llm.common import struct_udf, without, written

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 3
HOT = 512
SEED = 42
PROBE_COST = 4.0
_BLANKS = re.compile(rb"[^\x20\x09-\x0d]+")


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    words = _BLANKS.findall(text.encode().lower()) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(itertools.accumulate(map(len, words)))  # without the blanks between
    digest = xxhash.xxh64_intdigest
    width = min(shingle, len(words))
    starts = [0, *[e + k + 1 for k, e in enumerate(ends[:n - 1])]]
    stops = [e + k + width - 1 for k, e in enumerate(ends[width - 1:])]
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int((np.where(2 * ones > n, np.uint64(1), np.uint64(0)) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "simhash") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""
    schema = StructType([StructField("h", LongType())])

    def make():
        return lambda texts: [pa.array(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64))]

    done = docs.withColumn("_sh", struct_udf(schema, make)(F.col(text)))
    return without(done, out).select("*", F.col("_sh.h").alias(out)).drop("_sh")


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def bit_statistics(prints: DataFrame, col: str) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together."""

    def count(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            h = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for k in range(0, len(h), 1 << 16):
                b = np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (b.T @ b).astype(np.float64)
            n += len(h)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1)), pa.array([*both.astype(np.int64).tolist(), [n] * BITS])], ["row", "n"])

    rows = prints.select(F.col(col)).mapInArrow(count, "row long, n array<long>")
    sums = rows.select("row", F.posexplode("n").alias("col", "n")).groupBy("row", "col").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS + 1, BITS), np.int64)
    for r in sums.collect():  # 65 x 64 rows
        both[r["row"], r["col"]] = r["n"]
    return int(both[BITS, 0]), both[:BITS]


def partition_bits(n: int, both: np.ndarray) -> list[list[int]]:
    """Two partitions of 32 bits: from the most correlated pair on, the bit
    most correlated with those chosen joins them."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    chosen = [int(x) for x in np.unravel_index(corr.argmax(), corr.shape)] if corr.any() else [0, 1]
    while len(chosen) < BITS // 2:
        gain = corr[chosen].sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    return [sorted(chosen), sorted(set(range(BITS)) - set(chosen))]


def allocate(n: int, both: np.ndarray, parts: list[list[int]], bound: int) -> list[int]:
    """Thresholds of least cost with sum bound - len(parts) + 1, each -1 or
    more and at most half the bound (rounded up), by dynamic programming."""
    p = both.diagonal() / max(n, 1)
    costs = []
    for bits in parts:
        apart = np.zeros(len(bits) + 1)  # chance of each distance on these bits
        apart[0] = 1.0
        for b in bits:
            q = 2 * p[b] * (1 - p[b])
            apart[1:], apart[0] = apart[1:] * (1 - q) + apart[:-1] * q, apart[0] * (1 - q)
        probes = np.cumsum([math.comb(len(bits), d) for d in range(bound + 1)])
        costs.append([0.0, *(n * (PROBE_COST * probes[t] + n * apart[:t + 1].sum()) for t in range(bound + 1))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, bound - bound // 2 + 1):
                new = (cost + c[t + 1], [*ts, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[bound + 1][1]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of all flips of at most ``most`` of the bits."""
    return [_mask(c) for d in range(most + 1) for c in itertools.combinations(bits, d)]


def _around(df: DataFrame, col: str, bits: list[int], most: int, left: Column | None = None) -> DataFrame:
    """A row for ``col`` with each flip of up to ``most`` of ``bits`` (of up to
    ``left``, a column of at most ``most``, where it is given), and ``d``, the
    number of bits flipped."""
    masks = F.lit(_flips(bits, most))
    for k in range(most if left is not None else 0):
        masks = F.when(left == k, F.lit(_flips(bits, k))).otherwise(masks)
    if left is not None:
        masks = F.when(left >= 0, masks)
    rows = df.select("*", F.explode(masks).alias("_m"))
    return rows.withColumn(col, F.col(col).bitwiseXOR(F.col("_m"))).withColumn("d", F.bit_count("_m")).drop("_m")


def links(prints: DataFrame, bound: int = MAX_DISTANCE, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``h`` of ``prints``, each
    within the bound, that connect all fingerprints within the bound."""
    n, both = bit_statistics(prints, "h")
    parts = partition_bits(n, both)
    near, far = bound // 2, bound - bound // 2
    found = []
    for bits, other, t in zip(parts, parts[::-1], allocate(n, both, parts, bound), strict=True):
        if t < 0:
            continue
        mine = prints.select("h", F.col("h").bitwiseAND(F.lit(_mask(bits))).alias("value"))
        # one row for over ``hot`` fingerprints: small.  Spark takes an exploded side to be as
        # small as what it is made of, so the planner must not choose what to broadcast
        crowded = F.broadcast(mine.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("value"))
        probes = _around(mine.select(F.col("h").alias("p"), "value"), "value", bits, t)
        apart = F.bit_count(F.col("h").bitwiseXOR(F.col("p")))
        few = mine.join(crowded, "value", "left_anti")
        found.append(probes.hint("merge").join(few, (probes["value"] == few["value"]) & (apart <= bound) & (apart > 0)).select("h", "p"))
        # crowded values: members and probes meet at values of the other bits
        rest = F.lit(_mask(other))
        meet = mine.join(crowded, "value").select("value", "h", F.col("h").bitwiseAND(rest).alias("meet"))
        meet = _around(meet, "meet", other, near).groupBy("value", "meet").agg(F.min("h").alias("h"))
        visits = probes.join(crowded, "value") \
            .select("value", "p", F.col("p").bitwiseAND(rest).alias("meet"), (F.lit(far) - F.col("d")).alias("left"))
        visits = _around(visits, "meet", other, far, F.col("left")).select("value", "p", "meet")
        found.append(visits.hint("merge").join(meet, ["value", "meet"]).filter(F.col("h") != F.col("p")).select("h", "p"))
    return reduce(DataFrame.unionByName, found).select(F.least("h", "p").alias("a"), F.greatest("h", "p").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for
    nodes with edges.  Large and small stars in turn (each a grouped minimum
    joined back) until no edge changes; every round is written."""
    edges = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if edges.isEmpty():
            break
        # large star: what is larger than u links to the smallest neighbour of u
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u itself, link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))) \
            .filter(F.col("u") != F.col("v")).distinct()
        new = written(new, "edges")
        # done when every node has one link and no root has one
        state = new.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = new.select(F.col("v").alias("u")).distinct()
        edges = new
        if state.filter(F.col("n") > 1).isEmpty() and roots.join(new, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bound: int = MAX_DISTANCE, hot: int = HOT) -> DataFrame:
    """One row (doc_id, simhash, component_id) for each row of ``docs``."""
    rows = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle).drop("text"), "simhash")
    prints = written(rows.groupBy(F.col("simhash").alias("h")).agg(F.min("doc_id").alias("first")), "prints")
    groups = written(components(links(prints.select("h"), bound, hot)), "groups")
    named = prints.join(groups, prints["h"] == groups["node"], "left") \
        .select("h", F.coalesce("root", "h").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "root").select(F.col("h").alias("simhash"), "component_id")
    return rows.join(ids, "simhash").select("doc_id", "simhash", "component_id")
