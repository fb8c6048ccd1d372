"""Prefix trie of conversations by SQL ROLLUP.

A conversation is a row with one column for each of its first turns (a turn's
id: digest of role and text).  ``rollup`` over these columns makes, in one
aggregation with ``grouping_id``, the groups of all prefixes: the nodes of the
trie.  Longer conversations go on in a further block of columns (8, 16, then
32), whose first column is the node that they reached; a node with one member
has only a chain below it, which needs no aggregation.

A node is known by its smallest member and its depth, so the trie is a set of
paths, one for each conversation from the depth where it becomes the smallest
member.  Sums over subtrees are sums over members then, made by a second
rollup: ``n_leaves`` counts the members that are the smallest of a childless
node, and with s(c) = words of conversation c above its own path, nodes below
X share sum(s) - s(smallest) - (members - 1) * (words above X) words.

No window or list covers a whole group: turns are numbered by
``running_totals``, a hot first turn or conversation is pre-aggregated by the
rollup, and the ids that end at a node are joined in chunks by ranges; one
task only runs the digest over a node's chunks.

Results: turns are ordered by turn (null first), then role, then the turn's
digest; null roles and texts are empty; rows that repeat are turns of their
own.  A conversation without turns ends at the root.  Turns without a
conversation id belong to no conversation.  Without any conversation there is
no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm.common import written
from factlens.llm.running import running_totals

WORD = r"[^\x20\x09-\x0D]+"
WIDTHS = (8, 16, 32)
CHUNK = 4096
_EMPTY = hashlib.sha256().hexdigest()


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, d, t): each turn's conversation, number from 1, and struct of digest
    and words."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)))
    said = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("turn"), role_.alias("role"),
        F.struct(digest.alias("h"), F.regexp_count(text_, F.lit(WORD)).alias("w")).alias("t"))
    numbered = running_totals(said, ["c"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("t")], {"d": F.lit(1)})
    return written(numbered.select("c", (F.col("d") + 1).cast("int").alias("d"), "t"), "turns")


def graft(said: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns with each conversation's first h replaced by those of
    conversation c - c % every (h = crc32(c) % heads), and all conversations."""
    convs = written(said.groupBy("c").agg(F.max("d").alias("len")).select(
        "c", "len", (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("int").alias("h"),
        (F.col("c") - F.pmod("c", F.lit(every))).alias("base")), "convs")
    bases = convs.select(F.col("c").alias("base"), F.col("len").alias("base_len"))
    fitted = convs.join(bases, "base", "left") \
        .withColumn("given", F.least("h", F.coalesce("base_len", F.lit(0))))
    fitted = written(fitted.select("c", "h", "base", "given"), "fitted")
    opening = said.filter((F.col("d") < heads) & (F.pmod("c", F.lit(every)) == 0)).withColumnRenamed("c", "base")
    taken = fitted.filter(F.col("given") > 0).join(opening, "base").filter(F.col("d") <= F.col("given")).select("c", "d", "t")
    own = said.join(fitted, "c").filter(F.col("d") > F.col("h")) \
        .select("c", (F.col("d") - F.col("h") + F.col("given")).alias("d"), "t")
    return written(taken.unionByName(own), "grafted"), convs.select("c")


def _key(block: int, prev: Column, ids: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.lit(str(block)), prev["c"].cast("string"), *[F.hex(t["h"]) for t in ids])))


def _rollup(rows: DataFrame, block: int, low: int, width: int, *measures: Column) -> DataFrame:
    """The nodes of a block: key, parent's key (null: ``up``), c (smallest
    member), depth, n (members), above (words above the node), upto."""
    cols = [f"t{j}" for j in range(width)]
    t = [F.col(c) for c in cols]
    groups = rows.rollup("prev", *cols).agg(
        F.grouping_id().alias("gid"), F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), *measures)
    kept = F.lit(width) - F.bit_count("gid")  # columns of the group besides prev
    filled = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in t])
    nodes = groups.withColumn("_kept", kept).filter((F.col("_kept") >= (0 if block == 0 else 1)) & (filled == F.col("_kept")))
    inner = [F.when(F.col("_kept") > j + 1, x) for j, x in enumerate(t)]
    words = reduce(lambda a, b: a + b, [F.coalesce(x["w"], F.lit(0)).cast("bigint") for x in t])
    before = reduce(lambda a, b: a + b, [F.coalesce(x["w"], F.lit(0)).cast("bigint") for x in inner])
    extra = [c for c in groups.columns if c not in {"prev", "gid", "c", "n", *cols}]
    return nodes.select(
        _key(block, F.col("prev"), t).alias("key"), F.when(F.col("_kept") > 1, _key(block, F.col("prev"), inner)).alias("up_key"),
        F.when(F.col("_kept") == 1, F.col("prev.c")).alias("up"), "c", (F.col("_kept") + low).alias("depth"), "n",
        (F.col("prev.w") + before).alias("above"), (F.col("prev.w") + words).alias("upto"), *extra)


def _columns(said: DataFrame, members: DataFrame, low: int, width: int) -> DataFrame:
    """One row for each member with the turns low+1 ... low+width as columns."""
    part = said.filter((F.col("d") > low) & (F.col("d") <= low + width))
    lists = part.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "t"))).alias("_l"))  # width turns at most
    cols = [F.get("_l", F.lit(j))["t"].alias(f"t{j}") for j in range(width)]
    return members.join(lists, "c", "left").select("c", "len", "prev", *cols)


def _digests(ends: DataFrame) -> DataFrame:
    """(key, n_ends, ends_sha256) of the conversations (key, c)."""
    placed = running_totals(ends, ["key"], [F.asc("c")], {"i": F.lit(1)})
    chunks = placed.groupBy("key", F.floor(F.col("i") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("c")).alias("l")) \
        .select("key", "chunk", F.size("l").cast("bigint").alias("n"), F.array_join(F.col("l").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, n, out = None, None, 0, []
        for batch in batches:
            for k, m, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "ids")), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, n, sha.hexdigest()))
                    key, sha, n = k, hashlib.sha256(ids.encode()), m
                else:
                    sha.update(b"," + ids.encode())
                    n += m
            yield _batch(out)
            out = []
        if key is not None:
            yield _batch([(key, n, sha.hexdigest())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))],
            ["key", "n_ends", "ends_sha256"])

    in_order = chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "n", "ids")
    return in_order.mapInArrow(run, "key binary, n_ends bigint, ends_sha256 string")


def prefix_trie(said: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``said`` (``turns``) over all ``convs``: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    lens = said.groupBy("c").agg(F.max("d").alias("len"), F.sum(F.col("t.w").cast("bigint")).alias("words"))
    convs = written(convs.join(lens, "c", "left").select("c", F.coalesce("len", F.lit(0)).alias("len"),
                                                        F.coalesce("words", F.lit(0)).cast("bigint").alias("words")), "convs")
    root = convs.agg(F.min("c")).first()[0]
    start = F.struct(F.lit(root).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("w"))
    members, blocks, nodes, ends, chains, low = convs.select("c", "len", start.alias("prev")), [], [], [], [], 0
    while True:
        block = len(blocks)
        width = WIDTHS[min(block, len(WIDTHS) - 1)]
        rows = written(_columns(said, members, low, width), "block")
        found = written(_rollup(rows, block, low, width), "nodes")
        blocks.append((rows, low, width))
        nodes.append(found)
        keyed = rows.select("c", "len", _key(block, F.col("prev"), [F.col(f"t{j}") for j in range(width)]).alias("key"))
        ends.append(keyed.filter(F.col("len") <= low + width).select("key", "c"))
        reached = found.filter(F.col("depth") == low + width).select(
            "key", F.struct("c", F.col("upto").alias("w")).alias("prev"), "n")
        on = written(keyed.filter(F.col("len") > low + width).join(reached, "key").select("c", "len", "prev", "n"), "on")
        low += width
        chains.append(on.filter(F.col("n") == 1).select("c", "len", F.lit(low).alias("from")))
        members = on.filter(F.col("n") > 1).select("c", "len", "prev")
        if members.isEmpty():
            break
    chain = reduce(DataFrame.union, chains)
    every = reduce(DataFrame.union, nodes)
    ended = written(_digests(reduce(DataFrame.union, ends)), "ends")
    # second rollup: sums over members, by what the first has found
    own = every.groupBy("c").agg(F.min_by("above", "depth").alias("own"))
    leaf = every.join(ended, "key").filter(F.col("n") == F.col("n_ends")).select("c").union(chain.select("c")) \
        .distinct().withColumn("leaf", F.lit(1).cast("bigint"))
    values = written(convs.join(own, "c", "left").join(leaf, "c", "left").select(
        "c", F.coalesce("own", "words").alias("s"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "values")
    sums = [F.sum("s").alias("s"), F.min_by("s", "c").alias("s_own"), F.sum("leaf").alias("n_leaves")]
    done = written(reduce(DataFrame.union, [
        _rollup(rows.join(values, "c"), b, low, width, *sums) for b, (rows, low, width) in enumerate(blocks)]), "summed")
    above = every.select(F.col("key").alias("up_key"), F.col("c").alias("parent"))
    done = done.filter(F.col("up_key").isNotNull()).join(above, "up_key").unionByName(
        done.filter(F.col("up_key").isNull()).withColumn("parent", F.col("up")))
    done = written(done.select("key", "c", "depth", "parent", "n", "above", "s", "s_own", "n_leaves"), "linked")
    kids = done.filter(F.col("depth") > 0).select(F.col("parent").alias("c"), (F.col("depth") - 1).alias("depth")) \
        .union(chain.select("c", F.col("from"))).groupBy("c", "depth").agg(F.count(F.lit(1)).alias("n_children"))
    saved = F.col("s") - F.col("s_own") - (F.col("n") - 1) * F.col("above")
    inner = done.join(kids, ["c", "depth"], "left").join(ended, "key", "left").select(
        F.col("c").alias("conv_id"), F.col("depth").cast("bigint"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    last = F.col("depth") == F.col("len")
    tail = chain.select("c", "len", F.explode(F.sequence(F.col("from") + 1, F.col("len"))).alias("depth")).select(
        F.col("c").alias("conv_id"), F.col("depth").cast("bigint"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"), F.when(last, F.sha2(F.col("c").cast("string"), 256)).otherwise(_EMPTY).alias("ends_sha256"))
    return inner.union(tail)
