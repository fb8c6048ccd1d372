"""Nearest subjects by projection similarity, and close-example pools.

sim(i, j) = <s_i, s_j> / |s_j|^2 (the candidate's squared norm: not cosine,
not symmetric).  Every subject keeps its top k (self included), ordered by
similarity descending then id ascending.

Exact top-k without emitting all pairs: subjects are put into blocks, and
bundles of at most about ``BUNDLE_ROWS`` subjects are the tasks.  A bundle
keeps a list of the k best so far for each of its rows, reads the rows of the
blocks that its cells name as a stream, multiplies them in numpy and takes up
what reaches a row's k-th best.  Only whole lists leave a task, so k rows a
subject are written whatever the number of blocks, and what is shuffled are
the vectors, once for each bundle.

Above ``prune_rows`` subjects the blocks are clusters: a subject goes to the
pivot (a bounded hash sample of subjects) nearest by direction and norm, and a
crowded pivot is split by hash.  A block knows the largest angle to its pivot
and its norm interval, so a pair of blocks bounds all similarities in its cell
(|s_i| cos(angle between the pivots less both radii) / |s_j|).  The first
round forms the cells of the nearest blocks, as many as hold ``near`` * k
subjects; the least k-th best of a block's rows so far is its threshold, and
the second round forms those cells alone that can reach a threshold, and goes
on from the lists of the first.

``extend_topk`` adds subjects to an index: only new x all cells are formed,
and the old rows' k-th best are their thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.hashing import h32
from factlens.session import bounded_broadcast
from factlens.store import persisted

CHUNK_ROWS = 1024
MAX_GROUPS = 1_000_000
MAX_PIVOTS = 4096
MAX_CELLS = 1_000_000
#: Rows of a task: their lists are held in memory, k entries each.
BUNDLE_ROWS = 32_768
#: Rows of a partition where lists are ranked anew.
RANK_ROWS = 1_000_000
LIST_SCHEMA = "id long, js array<long>, sims array<double>"
#: Relative room for the rounding of bounds and products.
SLACK = 1e-9


@dataclass
class Search:
    """``topk`` (i, j, rank, sim), and how many of the cells were formed."""

    topk: DataFrame
    cells: int
    formed: int


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _dense(vectors: pa.ListArray) -> np.ndarray:
    """A column of equally long vectors as a matrix."""
    lengths = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if vectors.null_count or len(lengths) > 1:
        raise ValueError("all vectors have to be there, with one length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), int(lengths[0]))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class _Lists:
    """The k best candidates so far of at most ``CHUNK_ROWS`` rows."""

    def __init__(self, rows: pa.RecordBatch, k: int):
        self.ids, self.Q, self.k = _numbers(rows.column("id")), _dense(rows.column("vec")), k
        floor = _numbers(rows.column("floor")).astype(np.float64)
        self.floor = np.where(np.isnan(floor), -np.inf, floor - SLACK * np.abs(floor))
        seeds = rows.column("js")
        sizes = np.nan_to_num(seeds.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(int)
        self.found = [(np.repeat(np.arange(len(self.ids)), sizes), _numbers(seeds.flatten()).astype(np.int64),
                       _numbers(rows.column("sims").flatten()).astype(np.float64))]
        self.waiting = 0
        self.merge()

    def merge(self) -> None:
        """Keeps the k best of what was found; rows that have k know their floor."""
        r, j, sim = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((j, -sim, r))
        r, j, sim = r[order], j[order], sim[order]
        at = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        last = at == self.k - 1
        self.floor[r[last]] = np.maximum(self.floor[r[last]], sim[last])
        keep = at < self.k
        self.found, self.waiting = [(r[keep], j[keep], sim[keep])], 0

    def add(self, ids: np.ndarray, C: np.ndarray, inv: np.ndarray) -> None:
        S = (self.Q @ C.T) * inv[None, :]
        S = np.where(np.isnan(S), -np.inf, S)
        hits = S >= self.floor[:, None]
        if len(ids) > self.k and np.count_nonzero(hits) > 2 * self.k * len(self.ids):
            least = np.partition(S, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            hits &= S >= least[:, None]
        r, c = np.nonzero(hits)
        self.found.append((r, ids[c], S[r, c]))
        self.waiting += len(r)
        if self.waiting >= self.k * len(self.ids):
            self.merge()

    def lists(self) -> pa.RecordBatch:
        self.merge()
        r, j, sim = self.found[0]
        ends = np.searchsorted(r, np.arange(len(self.ids) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(j, pa.int64())),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(sim, pa.float64()))], ["id", "js", "sims"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """(bundle, side, block, rows) of each run of equal ones."""
    keys = np.stack([_numbers(batch.column(c)) for c in ("bundle", "side", "block")], axis=1)
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        if e > s:
            yield *keys[s].tolist(), batch.slice(s, e - s)


def _bundles(k: int):
    """Lists of each bundle's rows (side 0) from its cells (side 1: candidate
    block, row block) and its candidates (side 2), which come in this order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists, cells = None, {}, {}
        for batch in batches:
            for bundle, side, block, rows in _runs(batch):
                if bundle != at:
                    yield from (one.lists() for block_lists in lists.values() for one in block_lists)
                    at, lists, cells = bundle, {}, {}
                if side == 0:
                    lists.setdefault(block, []).extend(
                        _Lists(rows.slice(s, CHUNK_ROWS), k) for s in range(0, rows.num_rows, CHUNK_ROWS))
                elif side == 1:
                    cells.setdefault(block, []).extend(_numbers(rows.column("id")).tolist())
                else:
                    ids, C = _numbers(rows.column("id")).astype(np.int64), _dense(rows.column("vec"))
                    nn = np.einsum("ij,ij->i", C, C)
                    inv = np.where(nn > 0, 1.0 / np.where(nn > 0, nn, 1.0), np.nan)
                    for own in cells.get(block, []):
                        for one in lists.get(own, []):
                            one.add(ids, C, inv)
        yield from (one.lists() for block_lists in lists.values() for one in block_lists)
    return run


def _multiply(rows: DataFrame, cells: DataFrame, k: int, bundles: int, bundle=lambda block: block) -> DataFrame:
    """``id, js, sims``: the list of every row, by the cells (a, b) of row block
    and candidate block.  Rows have block, id, vec, floor and the list that they
    start with (js, sims), or nulls; ``bundle`` gives a block's bundle."""
    cells = cells.select(bundle(F.col("a")).cast("int").alias("bundle"), "a", F.col("b").alias("block"))
    shape = ["bundle", "side", "block", "id", "vec", "floor", "js", "sims"]
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("vec", "floor", "js", "sims")}
    queries = rows.withColumns({"bundle": bundle(F.col("block")).cast("int"), "side": F.lit(0)})
    named = cells.select("bundle", F.lit(1).alias("side"), "block", F.col("a").cast("bigint").alias("id")).withColumns(none)
    sides = bounded_broadcast(cells.select("bundle", "block").distinct(), 2 * MAX_CELLS)
    candidates = rows.select("block", "id", "vec").join(sides, "block").withColumns(
        {"side": F.lit(2)} | {c: none[c] for c in ("floor", "js", "sims")})
    dealt = queries.select(shape).union(named.select(shape)).union(candidates.select(shape))
    # a number of partitions that stays: small vectors make long tasks
    dealt = dealt.repartition(3 * bundles, "bundle").sortWithinPartitions("bundle", "side", "block")
    return dealt.mapInArrow(_bundles(k), LIST_SCHEMA)


def _start(rows: DataFrame) -> DataFrame:
    """``rows`` without a floor, with empty lists to start with."""
    return rows.withColumns({"floor": F.lit(None).cast("double"), "js": F.lit(None).cast("array<bigint>"),
                             "sims": F.lit(None).cast("array<double>")})


def _ranked(lists: DataFrame) -> DataFrame:
    """``i, j, rank, sim`` of the lists."""
    return lists.select(F.col("id").alias("i"), F.posexplode(F.arrays_zip("js", "sims")).alias("_at", "_p")).select(
        "i", F.col("_p.js").alias("j"), (F.col("_at") + 1).cast("bigint").alias("rank"), F.col("_p.sims").alias("sim"))


def _best(pairs: DataFrame, k: int, rows: int) -> DataFrame:
    """The k best of each i; ``rows`` is about the number of pairs."""
    # dealt first: the window's limit would sort the pairs as they are read, whole files at a time
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / RANK_ROWS))
    w = Window.partitionBy("i").orderBy(F.col("sim").desc(), F.col("j").asc())
    return pairs.repartition(tasks, "i").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
                .select("i", "j", F.col("rank").cast("bigint").alias("rank"), "sim")


def _floors(topk: DataFrame, k: int) -> DataFrame:
    """(id, floor): the k-th best similarity of each subject that has k."""
    return topk.filter(F.col("rank") == k).select(F.col("i").alias("id"), F.col("sim").alias("floor"))


def _vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")  # floats take half the shuffle
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))


def _hash_blocks(v: DataFrame, blocks: int) -> DataFrame:
    return v.withColumn("block", F.pmod(h32(F.col("id")), F.lit(blocks)).cast("int"))


def _least_blocks(v: DataFrame) -> int:
    """Two blocks for each core."""
    return 2 * v.sparkSession.sparkContext.defaultParallelism


def _all_cells(v: DataFrame, blocks: int) -> DataFrame:
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    return v.sparkSession.range(blocks).select(F.col("id").cast("int").alias("a")).select("a", F.explode(every).alias("b"))


def _both_ways(cells: DataFrame) -> DataFrame:
    """Cells (a, b), a <= b, for the rows of either block."""
    return cells.union(cells.filter(F.col("a") < F.col("b")).select("b", "a"))


class _Clusters:
    """Blocks around pivots, and the bounds of their cells."""

    def __init__(self, v: DataFrame, n: int, block_rows: int):
        spark = v.sparkSession
        wanted = min(MAX_PIVOTS, max(_least_blocks(v), math.ceil(n / block_rows)))
        sample = v.select("id", "vec").orderBy(h32(F.col("id")), "id").limit(wanted).collect()
        dense = np.array([r["vec"] for r in sample], np.float64)
        norms = np.linalg.norm(dense, axis=1)
        self.unit, self.log = dense[norms > 0] / norms[norms > 0, None], np.log(norms[norms > 0])
        sent = spark.sparkContext.broadcast((self.unit, self.log))

        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            unit, log = sent.value
            for vecs in batches:
                V = _matrix(vecs)
                norm = np.linalg.norm(V, axis=1)
                known = norm > 0
                pivot, angle = np.full(len(V), len(unit)), np.full(len(V), np.pi)  # null vectors: a block without a bound
                if len(unit) and known.any():
                    cos = (V[known] / norm[known, None]) @ unit.T
                    at = np.argmax(cos - (np.log(norm[known])[:, None] - log[None, :]) ** 2 / 2, axis=1)
                    pivot[known] = at
                    angle[known] = np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1))
                yield pd.DataFrame({"pivot": pivot, "angle": angle, "norm": norm})

        udf = F.pandas_udf(nearest, "pivot int, angle double, norm double", F.PandasUDFType.SCALAR_ITER)
        near = persisted(v.withColumn("_p", udf("vec")).select("id", "vec", "_p.*"), "pivots")
        parts = np.ones(len(self.unit) + 1, int)
        for r in near.groupBy("pivot").count().collect():
            parts[r["pivot"]] = math.ceil(r["count"] / block_rows)
        first = np.concatenate([[0], np.cumsum(parts)])
        # two literal arrays of at most MAX_PIVOTS + 1 numbers
        at = F.element_at(F.lit(first[:-1].tolist()), F.col("pivot") + 1)
        split = F.element_at(F.lit(parts.tolist()), F.col("pivot") + 1)
        rows = near.withColumn("block", (at + F.pmod(h32(F.concat(F.lit("part"), F.col("id").cast("string"))), split)).cast("int"))
        self.rows = rows.select("id", "vec", "block", "angle", "norm")
        self.pivot = np.repeat(np.arange(len(parts)), parts)
        self.blocks = len(self.pivot)
        self.size, self.angle = np.zeros(self.blocks), np.zeros(self.blocks)
        self.low, self.high = np.zeros(self.blocks), np.zeros(self.blocks)
        # a few numbers for each block, of which there is one in block_rows subjects
        for r in self.rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("x"), F.min("norm").alias("l"),
                                                F.max("norm").alias("h")).collect():
            self.size[r["block"]], self.angle[r["block"]], self.low[r["block"]], self.high[r["block"]] = r["n"], r["x"], r["l"], r["h"]

    def bundles(self, rows: int):
        """Number of bundles of about ``rows`` rows in blocks that follow one
        another, and the bundle of a block."""
        of = ((np.cumsum(self.size) - self.size) // rows).astype(int)
        of = np.unique(of, return_inverse=True)[1]
        return int(of.max()) + 1, lambda block: F.element_at(F.lit(of.tolist()), block + 1)

    def bounds(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of sim(a's rows, b's rows) and sim(b's, a's) for all blocks b."""
        unit = np.vstack([self.unit, np.zeros((1, self.unit.shape[1]))]) if len(self.unit) else np.zeros((1, 1))
        cos = unit[self.pivot] @ unit[self.pivot[a]]
        gap = np.maximum(0.0, np.arccos(np.clip(cos, -1, 1)) - self.angle - self.angle[a])
        c = np.where((self.pivot == self.pivot[a]) | (gap <= 0), 1.0, np.cos(gap))

        def bound(q_low, q_high, c_low, c_high):
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(c > 0, q_high * c / c_low, q_low * c / c_high)
            return np.where((c_low > 0) & (q_low > 0), up + SLACK * np.abs(up), np.inf)

        to = bound(self.low[a], self.high[a], self.low, self.high)
        fro = bound(self.low, self.high, self.low[a], self.high[a])
        full = self.size > 0
        return np.where(full, to, -np.inf), np.where(full, fro, -np.inf)

    def cells(self, choose) -> DataFrame:
        """Cells (a, b), a <= b, of the blocks ``choose(self, a)`` for each block a."""
        spark = self.rows.sparkSession
        sent = spark.sparkContext.broadcast(_Bounds(self))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = sent.value
            for batch in batches:
                for a in batch["id"].tolist():
                    b = choose(known, a) if known.size[a] else np.empty(0, int)
                    yield pd.DataFrame({"a": np.minimum(a, b).astype("int32"), "b": np.maximum(a, b).astype("int32")})

        tasks = min(self.blocks, 4 * spark.sparkContext.defaultParallelism)
        return spark.range(0, self.blocks, 1, tasks).mapInPandas(run, "a int, b int").distinct()


class _Bounds:
    """What tasks need of ``_Clusters``."""

    bounds = _Clusters.bounds

    def __init__(self, known: _Clusters):
        for name in ("unit", "pivot", "size", "angle", "low", "high"):
            setattr(self, name, getattr(known, name))


def _nearest_blocks(wanted: float):
    def choose(known, a: int) -> np.ndarray:
        to, _ = known.bounds(a)
        order = np.lexsort((np.arange(len(to)) != a, -to))
        order = np.concatenate([[a], order[order != a]])
        order = order[known.size[order] > 0]
        return order[:1 + int(np.searchsorted(np.cumsum(known.size[order]), wanted))]
    return choose


def _blocks_within(threshold: np.ndarray):
    def choose(known, a: int) -> np.ndarray:
        to, fro = known.bounds(a)
        b = np.flatnonzero((known.size > 0) & ((to >= threshold[a]) | (fro >= threshold)))
        return b[b >= a]
    return choose


def search(vectors: DataFrame, k: int = 301, id_col: str = "id", vec_col: str = "vec", block_rows: int = 8192,
           prune_rows: int = 32_768, near: float = 4.0) -> Search:
    """Top-k candidates j of every subject i, and the share of cells formed."""
    v = _vectors(vectors, id_col, vec_col)
    n, subjects = v.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if subjects < n:  # a subject is listed once, whatever the number of its rows
        v, n = v.groupBy("id").agg(F.min("vec").alias("vec")), subjects
    if n <= prune_rows:
        blocks = max(_least_blocks(v), math.ceil(n / min(block_rows, BUNDLE_ROWS)))
        cells = blocks * (blocks + 1) // 2
        return Search(_ranked(_multiply(_start(_hash_blocks(v, blocks)), _all_cells(v, blocks), k, blocks)), cells, cells)
    known = _Clusters(v, n, block_rows)
    bundles, bundle = known.bundles(min(BUNDLE_ROWS, math.ceil(n / _least_blocks(v))))
    rows = known.rows.select("id", "vec", "block")
    first = persisted(known.cells(_nearest_blocks(near * k)), "cells")
    best = persisted(_multiply(_start(rows), _both_ways(first), k, bundles, bundle), "nearest")
    floor = F.when(F.size("js") >= k, F.element_at("sims", k))
    floored = persisted(rows.join(best.withColumn("floor", floor), "id", "left"), "floors")
    threshold = np.full(known.blocks, -np.inf)
    for r in floored.groupBy("block").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("t")).collect():
        threshold[r["block"]] = r["t"] - SLACK * abs(r["t"]) if math.isfinite(r["t"]) else r["t"]
    rest = persisted(known.cells(_blocks_within(threshold)).join(first, ["a", "b"], "left_anti"), "cells")
    full = int((known.size > 0).sum())
    formed = first.count() + rest.count()
    return Search(_ranked(_multiply(floored, _both_ways(rest), k, bundles, bundle)), full * (full + 1) // 2, formed)


def projection_topk(vectors: DataFrame, k: int = 301, id_col: str = "id", vec_col: str = "vec",
                    block_rows: int = 8192, **options) -> DataFrame:
    """``i, j, rank, sim`` for the top-k candidates j of every subject i."""
    return search(vectors, k, id_col, vec_col, block_rows, **options).topk


def extend_topk(topk: DataFrame, old: DataFrame, new: DataFrame, k: int = 301, id_col: str = "id", vec_col: str = "vec",
                block_rows: int = 8192) -> DataFrame:
    """The index ``topk`` of the subjects ``old``, extended by the subjects
    ``new`` whose ids it lacks: equal to ``projection_topk`` of all of them, by
    new x old and new x new products alone."""
    o = _vectors(old, id_col, vec_col)
    v = _vectors(new, id_col, vec_col).join(o.select("id"), "id", "left_anti").dropDuplicates(["id"])
    v = persisted(v, "new")
    n_old, n_new = o.count(), v.count()
    few, many = (max(_least_blocks(o), math.ceil(n / min(block_rows, BUNDLE_ROWS))) for n in (n_new, n_old))
    blank = _start(_hash_blocks(v, few).withColumn("block", F.col("block") + many))
    rows = _start(_hash_blocks(o, many)).drop("floor").join(_floors(topk, k), "id", "left").unionByName(blank)
    fresh = o.sparkSession.range(many, many + few).select(F.col("id").cast("int").alias("b"))
    cells = fresh.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("a"), "b")
    found = _ranked(_multiply(rows, _both_ways(cells), k, many + few)).select("i", "j", "sim")
    return _best(topk.select("i", "j", "sim").unionByName(found), k, (n_old + n_new) * k)


UNRANKED, SELF = 400, 1000


def close_subjects(topk: DataFrame, members: DataFrame, n: int = 20, k: int = 301) -> DataFrame:
    """For each (rel, subj): the n same-relation subjects that come first when
    ordered by their position in subj's global top-k list (0-based), with
    subjects outside the list at 400, subj itself at 1000, ties by id.

    Only the n best ranked subjects of the relation are kept, and what is
    missing of n is added from the relation's n + 1 smallest ids, which are
    drawn once: without the r < n ranked ones and the subject itself, at least
    n - r of them are left if the relation has as many.
    """
    m = members.select("rel", F.col("id").alias("subj"))
    mc = members.select("rel", F.col("id").alias("cand"))
    near = (topk.select(F.col("i").alias("subj"), F.col("j").alias("cand"), (F.col("rank") - 1).alias("key"))
            .filter(F.col("i") != F.col("j")).join(m, "subj").join(mc, ["rel", "cand"]))
    place = Window.partitionBy("rel", "subj").orderBy("key")
    ranked = near.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= n).drop("_r")
    full = ranked.groupBy("rel", "subj").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select("rel", "subj")
    short = m.join(full, ["rel", "subj"], "left_anti")
    wr = Window.partitionBy("rel").orderBy("cand")
    fill = mc.withColumn("_r", F.row_number().over(wr)).filter(F.col("_r") <= n + 1).drop("_r")
    fill = bounded_broadcast(fill, MAX_GROUPS)
    unranked = (short.join(fill, "rel").filter(F.col("subj") != F.col("cand"))
                .join(ranked.select("rel", "subj", "cand"), ["rel", "subj", "cand"], "left_anti")
                .withColumn("key", F.lit(UNRANKED)))
    self_rows = short.select("rel", "subj", F.col("subj").alias("cand"), F.lit(SELF).alias("key"))
    allc = ranked.select("rel", "subj", "cand", "key").unionByName(unranked.select("rel", "subj", "cand", "key")) \
        .unionByName(self_rows)
    w = Window.partitionBy("rel", "subj").orderBy("key", "cand")
    return allc.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n) \
               .select("rel", "subj", "cand", F.col("pos").cast("bigint").alias("pos"))
