"""Scores to ranked predictions.

Logits arrive as ``(key..., token, logit)`` rows: from a model through
``score_prompts`` or from a table.  Tokens outside the vocabulary are
removed *before* the softmax, which equals the reference's masking with a
-1e20 penalty (their probability is 0 and they never reach the top k);
with fewer allowed tokens than k, fewer predictions are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.session import bounded_broadcast

MAX_VOCAB = 5_000_000
CHUNK_ROWS = 1 << 18


def allowed_logits(logits: DataFrame, vocab: DataFrame | None) -> DataFrame:
    if vocab is None:
        return logits
    v = bounded_broadcast(vocab.select("token").distinct(), MAX_VOCAB)
    return logits.join(v, "token", "left_semi")


def _groups(table: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row by ``keys``, and a row of each group."""
    code = np.zeros(len(table), np.int64)
    for key in keys:
        column = table.column(key).combine_chunks().dictionary_encode("encode")
        code = code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code, first


class _Ranked:
    """A chunk of logits by key: rows in rank order, and the softmax parts.

    A row without a token stands for candidates that were left out: its logit
    is the logarithm of their summed exponentials."""

    def __init__(self, table: pa.Table, keys: tuple[str, ...], k: int):
        self.table, self.keys = table, keys
        gid, self.first = _groups(table, keys)
        n = len(self.first)
        token = table.column("token").combine_chunks().dictionary_encode("encode")
        names = token.dictionary
        by_bytes = pc.array_sort_indices(names, null_placement="at_end").to_numpy()
        place = np.empty(len(names), np.int64)
        place[by_bytes] = np.arange(len(names))
        place = place[token.indices.to_numpy(zero_copy_only=False)]
        rest = pc.is_null(table.column("token")).to_numpy(zero_copy_only=False)
        logit = table.column("logit").to_numpy()
        self.top = np.full(n, -np.inf)
        np.maximum.at(self.top, gid, logit)
        with np.errstate(invalid="ignore"):
            mass = np.exp(logit - self.top[gid])
        self.z = np.bincount(gid, mass, n)
        order = np.lexsort((place, -logit, rest, gid))
        starts = np.searchsorted(gid[order], np.arange(n))
        pos = np.arange(len(order)) - starts[gid[order]]
        kept = order[(pos < k) & ~rest[order]]
        self.rows, self.gid, self.logit = kept, gid[kept], logit[kept]
        self.kept_z = np.bincount(self.gid, mass[kept], n)

    def combined(self) -> pa.Table:
        """The k best rows of each key and one row for the others."""
        left = self.z - self.kept_z
        some = np.flatnonzero(left > 1e-18 * self.z)
        with np.errstate(divide="ignore"):
            rest = self.top[some] + np.log(left[some])
        at = np.concatenate([self.rows, self.first[some]])
        tokens = self.table.column("token").take(self.rows).combine_chunks()
        columns = [self.table.column(key).take(at) for key in self.keys]
        return pa.table([*columns, pa.concat_arrays([tokens, pa.nulls(len(some), tokens.type)]), np.concatenate([self.logit, rest])],
                        [*self.keys, "token", "logit"])

    def arrays(self) -> pa.Table:
        """One row a key with the tokens and probabilities in rank order."""
        ends = pa.array(np.searchsorted(self.gid, np.arange(len(self.first) + 1)), pa.int32())
        tokens = self.table.column("token").take(self.rows).combine_chunks()
        probs = np.exp(self.logit - self.top[self.gid]) / self.z[self.gid]
        out = self.table.select(self.keys).take(self.first)
        out = out.append_column("preds", pa.ListArray.from_arrays(ends, tokens))
        return out.append_column("probs", pa.ListArray.from_arrays(ends, pa.array(probs)))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches in chunks of bounded size."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _fields(rows: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def combine_logits(logits: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """``keys..., token, logit`` with at most k + 1 rows for each key and chunk
    of a task: its k best candidates, and a row without a token whose logit is
    the logarithm of the others' summed exponentials.  Combining again, or all
    of several parts at once, gives the same ranking and softmax."""
    rows = logits.select(*keys, "token", F.col("logit").cast("double").alias("logit")).filter(F.col("token").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            yield from _Ranked(table, keys, k).combined().to_batches()

    return rows.mapInArrow(run, f"{_fields(rows, keys)}, token string, logit double")


def topk_arrays(logits: DataFrame, vocab: DataFrame | None, k: int = 20, keys: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """``keys..., preds, probs``: tokens and probabilities in rank order, by one
    pass: candidates are combined in the tasks that make them, and a key's
    few rows are put together behind the shuffle."""
    parts = combine_logits(allowed_logits(logits, vocab), k, keys)
    both = parts.groupBy(*keys).agg(F.max("logit").alias("_m"), F.collect_list(F.struct(
        F.col("token").isNull().alias("rest"), (-F.col("logit")).alias("down"), "token")).alias("_l"))
    z = F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(-x["down"] - F.col("_m")))
    both = both.select(*keys, "_m", z.alias("_z"), F.filter(F.slice(F.array_sort("_l"), 1, k), lambda x: ~x["rest"]).alias("_t"))
    return both.select(*keys, F.col("_t.token").alias("preds"),
                       F.transform("_t", lambda x: F.exp(-x["down"] - F.col("_m")) / F.col("_z")).alias("probs"),
                       F.transform("_t", lambda x: -x["down"]).alias("logits"))


@dataclass
class _List:
    """The candidates of a relation in one run, in token order."""

    run_id: int
    tokens: pa.Array
    tokens_l: pa.Array  # lower-cased
    codes: np.ndarray  # of tokens_l among the relation's names
    own: dict[str, np.ndarray]
    null: np.ndarray  # candidates whose logit is null

    def ranked(self, logit_fn: Callable, rows: dict, null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of ``rows`` the places of its k best candidates and their
        probabilities, and whether it has a null logit (these rank first, and
        the row has no probabilities)."""
        n, width = len(null), len(self.tokens)
        logit = logit_fn(lambda name: self.own[name] if name in self.own else rows[name])
        down = -np.broadcast_to(np.asarray(logit, np.float64), (n, width))
        if null.any() or self.null.any():
            down = np.where(null[:, None] | self.null, -np.inf, down)
        if 2 * k < width:
            near = np.argpartition(down, k, axis=1)[:, :k]
            by = np.take_along_axis(down, near, 1)
            order = np.argsort(by, axis=1)
            best, by = np.take_along_axis(near, order, 1), np.take_along_axis(by, order, 1)
            tied = (down <= by[:, -1:]).sum(1) != k
        else:
            best = np.argsort(down, axis=1)[:, :k]
            by = np.take_along_axis(down, best, 1)
            tied = (down <= by[:, -1:]).sum(1) != best.shape[1]
        # equal logits go by token, and a sum of one order is taken as it is
        tied |= (by[:, 1:] == by[:, :-1]).any(1) | np.isnan(by).any(1)
        if tied.any():
            best[tied] = np.argsort(down[tied], axis=1, kind="stable")[:, :k]
            by = np.take_along_axis(down, best, 1)
        with np.errstate(invalid="ignore", over="ignore"):
            low = by[:, :1]
            probs = np.exp(low - by) / np.exp(low - down).sum(1, keepdims=True)
        return best, probs, null | self.null.any()


def _values(column: pa.Array, gone: np.ndarray) -> np.ndarray:
    if gone.any() and not pa.types.is_nested(column.type):
        column = column.fill_null(pa.scalar(False if pa.types.is_boolean(column.type) else "" if pa.types.is_string(column.type) else 0, column.type))
    return column.to_numpy(zero_copy_only=False)


@dataclass
class _Relation:
    """A relation's candidates: their lower-cased tokens, and a list for each run."""

    names: pa.Array
    lists: list[_List]


def candidate_lists(cands: pa.Table, own: list[str]) -> dict[str, tuple]:
    """Candidates by relation from rows (rel, run_id, token, _lower, own columns):
    the fields of a ``_Relation`` and its lists, as plain values to send."""
    cands = cands.filter(pc.is_valid(cands.column("rel")))
    cands = cands.sort_by([("rel", "ascending"), ("run_id", "ascending"), ("token", "ascending")]).combine_chunks()
    found: dict[str, tuple] = {}
    if not len(cands):
        return found
    names = dict(zip(*(cands.group_by("rel").aggregate([("_lower", "distinct")]).column(c).to_pylist() for c in ("rel", "_lower_distinct")), strict=True))
    code, _ = _groups(cands, ("rel", "run_id"))
    ends = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        part = cands.slice(a, b - a).combine_chunks()
        rel, lower, null, values = part.column("rel")[0].as_py(), _array(part, "_lower"), np.zeros(len(part), bool), {}
        if rel not in found:
            found[rel] = (pa.array(names[rel], pa.string()), [])
        for name in own:
            gone = pc.is_null(part.column(name)).to_numpy()
            null |= gone
            values[name] = _values(_array(part, name), gone)
        codes = pc.index_in(lower, found[rel][0]).to_numpy(zero_copy_only=False)
        found[rel][1].append((part.column("run_id")[0].as_py(), _array(part, "token"), lower, codes, values, null))
    return found


def _array(table: pa.Table, name: str) -> pa.Array:
    """A column as one array that owns no more than its rows."""
    return pa.concat_arrays(table.column(name).chunks)


#: Rows and (row, candidate) pairs that are ranked at a time.
LISTED_ROWS, LISTED_CELLS = 1024, 1 << 17
_LISTS = "preds: array<string>, preds_l: array<string>, probs: array<double>"
_FOUND = "found: array<struct<pos: int, prob: double>>"


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class _Slice:
    """The predictions of some rows in all runs, by row and then by run."""

    def __init__(self, relations: dict[str, _Relation], rel: pa.Array, values: dict[str, pa.Array], logit_fn: Callable, k: int):
        n = len(rel)
        self.null, self.values = np.zeros(n, bool), {}
        for name, column in values.items():
            gone = pc.is_null(column).to_numpy(zero_copy_only=False)
            self.null |= gone
            self.values[name] = _values(column, gone)[:, None]
        names = rel.dictionary_encode()
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.groups = [(np.flatnonzero(code == i), relations[name]) for i, name in enumerate(names.dictionary.to_pylist()) if name in relations]
        runs = np.zeros(n, np.int64)
        for at, of in self.groups:
            runs[at] = len(of.lists)
        self.run_ends, self.logit_fn, self.k = _ends(runs), logit_fn, k
        self.run_id = np.zeros(self.run_ends[-1], np.int64)
        for at, of in self.groups:
            self.run_id[self.run_ends[at][:, None] + np.arange(len(of.lists))] = [x.run_id for x in of.lists]

    def ranked(self, at: np.ndarray, one: _List) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, LISTED_CELLS // len(one.tokens))
        for i in range(0, len(at), step):
            here = at[i:i + step]
            yield slice(i, i + step), *one.ranked(self.logit_fn, {c: v[here] for c, v in self.values.items()}, self.null[here], self.k)

    def out(self, columns: dict[str, pa.Array]) -> pa.Array:
        struct = pa.StructArray.from_arrays([pa.array(self.run_id), *columns.values()], ["run_id", *columns])
        return pa.ListArray.from_arrays(pa.array(self.run_ends, pa.int32()), struct)

    def lists(self) -> pa.Array:
        """preds, preds_l and probs of each row and run."""
        width = np.zeros(len(self.run_id), np.int64)
        for at, of in self.groups:
            width[self.run_ends[at][:, None] + np.arange(len(of.lists))] = [min(self.k, len(x.tokens)) for x in of.lists]
        ends = _ends(width)
        pick, probs, none = np.zeros(ends[-1], np.int64), np.zeros(ends[-1]), np.zeros(ends[-1], bool)
        tokens, tokens_l, base = [pa.array([], pa.string())], [pa.array([], pa.string())], 0
        for at, of in self.groups:
            for j, one in enumerate(of.lists):
                for part, best, p, gone in self.ranked(at, one):
                    to = ends[self.run_ends[at[part]] + j][:, None] + np.arange(best.shape[1])
                    pick[to], probs[to], none[to] = best + base, p, gone[:, None]
                tokens.append(one.tokens)
                tokens_l.append(one.tokens_l)
                base += len(one.tokens)
        offsets, pick = pa.array(ends, pa.int32()), pa.array(pick)
        columns = [pa.concat_arrays(tokens).take(pick), pa.concat_arrays(tokens_l).take(pick), pa.array(probs, mask=none)]
        return self.out({c: pa.ListArray.from_arrays(offsets, x) for c, x in zip(("preds", "preds_l", "probs"), columns, strict=True)})

    def found(self, targets: pa.Array) -> pa.Array:
        """For each row and run where the row's targets (lower-cased) are
        first among the predictions (0: nowhere), and the probabilities there."""
        targets = targets.cast(pa.list_(pa.string()))
        names, size = targets.flatten(), pc.fill_null(pc.list_value_length(targets), 0).to_numpy(zero_copy_only=False)
        first = _ends(size)
        rows = np.repeat(np.arange(len(size)), np.diff(self.run_ends))  # of each (row, run)
        ends = _ends(size[rows])
        pos, probs = np.zeros(ends[-1], np.int32), np.zeros(ends[-1])
        none, unknown = np.zeros(ends[-1], bool), pc.is_null(names).to_numpy(zero_copy_only=False)
        for at, of in self.groups:
            mine = np.repeat(np.arange(len(at)), size[at])  # a target's row among ``at``
            nth = np.arange(len(mine)) - np.repeat(_ends(size[at])[:-1], size[at])
            target = first[at][mine] + nth
            code = pc.fill_null(pc.index_in(names, of.names, skip_nulls=True), -1).to_numpy(zero_copy_only=False)[target]
            starts = _ends(size[at])
            for j, one in enumerate(of.lists):
                for part, best, p, gone in self.ranked(at, one):
                    some = slice(starts[part.start], starts[min(part.stop, len(at))])
                    row = mine[some] - part.start
                    same = one.codes[best][row] == code[some][:, None]
                    place = same.argmax(1)
                    hit = same[np.arange(len(row)), place] if len(row) else np.zeros(0, bool)
                    to = ends[self.run_ends[at[mine[some]]] + j] + nth[some]
                    pos[to] = np.where(hit, place + 1, 0)
                    probs[to], none[to] = p[row, place], gone[row]
            for j in range(len(of.lists)):
                lost = unknown[target]
                pos[(ends[self.run_ends[at[mine]] + j] + nth)[lost]] = -1
        struct = pa.StructArray.from_arrays([pa.array(pos, mask=pos < 0), pa.array(probs, mask=none)], ["pos", "prob"])
        return self.out({"found": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)})


def listed_topk_arrays(rows: DataFrame, cands: DataFrame, logit_fn: Callable, row_cols: list[str], k: int = 20,
                       targets: str | None = None) -> DataFrame:
    """``rows`` (with ``rel``) with ``run_id, preds, preds_l, probs``, a row for
    each run of ``cands`` (rel, run_id, token and a run's own columns), which
    has to be small; null where a relation has no candidate.  With ``targets``
    (the name of a column of arrays) with ``found`` in place of the lists: of
    each target the place of the first prediction that equals it but for the
    case (0: none), and the probability there.

    A relation's candidates go to the tasks as one list for each run, so that
    a row of ``rows`` meets all of them where it is: it is scored by
    ``logit_fn`` on NumPy arrays (``row_cols`` down, candidates across) and only
    the k best come back.  Nothing is shuffled."""
    own = [c for c in cands.columns if c not in ("rel", "run_id", "token")]
    sent = rows.sparkSession.sparkContext.broadcast(candidate_lists(cands.withColumn("_lower", F.lower("token")).toArrow(), own))
    by_target = targets is not None

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        relations = {rel: _Relation(names, [_List(*x) for x in lists]) for rel, (names, lists) in sent.value.items()}
        for rel, wanted, *cols in batches:
            for i in range(0, len(rel), LISTED_ROWS):
                values = {c: v.slice(i, LISTED_ROWS) for c, v in zip(row_cols, cols, strict=True)}
                part = _Slice(relations, rel.slice(i, LISTED_ROWS), values, logit_fn, k)
                yield part.found(wanted.slice(i, LISTED_ROWS)) if by_target else part.lists()

    listed = F.arrow_udf(run, f"array<struct<run_id: bigint, {_FOUND if by_target else _LISTS}>>", F.ArrowUDFType.SCALAR_ITER)
    wanted = F.transform(targets, F.lower) if by_target else F.lit(0)
    return rows.withColumn("_runs", listed(F.col("rel"), wanted, *[F.col(c) for c in row_cols])) \
        .select(*rows.columns, F.inline_outer("_runs"))


def lowered(arrays: DataFrame) -> DataFrame:
    """``arrays`` with ``preds_l``, the predictions in lower case (for the metrics)."""
    return arrays.withColumn("preds_l", F.transform("preds", F.lower))


def masked_topk(logits: DataFrame, vocab: DataFrame | None, k: int = 20,
                keys: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """Long form top-k: ``keys..., rank, token, logit, prob``.

    prob = softmax over the allowed tokens of the key; ranks are 1-based,
    by logit descending then token ascending.  No candidate list is sorted or
    shuffled whole, see ``combine_logits``."""
    a = topk_arrays(logits, vocab, k, keys)
    rows = a.select(*keys, F.posexplode(F.arrays_zip(F.col("preds").alias("token"), F.col("logits").alias("logit"), F.col("probs").alias("prob"))).alias("_i", "_r"))
    return rows.select(*keys, (F.col("_i") + 1).alias("rank"), "_r.token", "_r.logit", "_r.prob")


def placed_topk_arrays(logits: DataFrame, together: str, k: int = 20, keys: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """``topk_arrays`` where all rows of one value of ``together`` (one of
    ``keys``, without nulls) follow one another in one task, as behind a join
    that streams one row for each value: nothing is shuffled.  A value's rows
    beyond a chunk are combined while they come."""
    rows = logits.select(*keys, "token", F.col("logit").cast("double").alias("logit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for table in _tables(batches):
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            value = table.column(together).combine_chunks()
            changes = np.flatnonzero(pc.not_equal(value[1:], value[:-1]).to_numpy(zero_copy_only=False))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield from _Ranked(table.slice(0, cut).combine_chunks(), keys, k).arrays().to_batches()
            held = table.slice(cut).combine_chunks()
            if len(held) >= CHUNK_ROWS:
                held = _Ranked(held, keys, k).combined()
        if held is not None:
            yield from _Ranked(held, keys, k).arrays().to_batches()

    return rows.mapInArrow(run, f"{_fields(rows, keys)}, preds array<string>, probs array<double>")


def prediction_arrays(topk: DataFrame, keys: tuple[str, ...] = ("uuid",), k: int = 20) -> DataFrame:
    """Collapse the long top-k to ``keys..., preds, preds_l, probs`` in rank
    order (``preds_l`` lower-cased, for the metrics).

    The arrays are collected by a window with the same partitioning and
    order as the ranking window, so the rows are already in place: no second
    sort or shuffle, and a group holds at most k rows.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("rank")).rowsBetween(Window.unboundedPreceding,
                                                                       Window.unboundedFollowing)
    item = F.struct("token", F.lower("token").alias("token_l"), "prob")
    g = topk.withColumn("_p", F.collect_list(item).over(w)).filter(F.col("rank") == 1)
    return g.select(*keys, F.col("_p.token").alias("preds"), F.col("_p.token_l").alias("preds_l"),
                    F.col("_p.prob").alias("probs"))


def score_prompts(prompts: DataFrame, scorer_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  schema: str = "uuid string, token string, logit double",
                  text_col: str = "x_primed", key_col: str = "uuid") -> DataFrame:
    """Run a caller's batch scorer over prompts with ``mapInPandas``.

    ``scorer_factory()`` is called once per task (load the model there);
    the returned function receives an Arrow batch as a pandas frame with
    columns ``key_col, text_col`` and returns rows matching ``schema``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            out = scorer(pdf)
            if len(out):
                yield out

    return prompts.select(key_col, text_col).mapInPandas(run, schema)


def encode_subjects(subjects: DataFrame, encoder_factory, dim_schema: str = "subj string, emb array<double>",
                    subj_col: str = "subj") -> DataFrame:
    """Subject embeddings from a caller's batch encoder (``mapInPandas``):
    ``encoder_factory()`` is called once per task and returns a function from
    a pandas frame with column ``subj`` to a frame (subj, emb).  Distinct
    subjects are encoded once."""
    def run(batches):
        enc = encoder_factory()
        for pdf in batches:
            out = enc(pdf)
            if len(out):
                yield out

    return subjects.select(F.col(subj_col).alias("subj")).distinct().mapInPandas(run, dim_schema)
