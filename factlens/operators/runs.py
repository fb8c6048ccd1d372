"""Experiment grids, run summaries and the summary store.

A grid of run configurations is a *column dimension*: each example row is
exploded once per configuration (a literal array, bounded by the grid),
and every later step simply carries the configuration columns in its
keys.  All runs of one scorer are therefore one Spark plan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.operators import evaluation as ev
from factlens.operators import scoring as sc
from factlens.session import bounded_broadcast, row_count_at_most

CONFIG_COLS = ["model", "num_examples", "priming_type", "use_close_examples", "random_seed"]
RUN_KEY = ["data"] + CONFIG_COLS
MAX_CANDIDATES = 5_000_000


def sql_literal(v) -> str:
    """SQL text of a Python literal (str, bool, int, float)."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def struct_array_expr(rows: list[dict]) -> F.Column:
    """One literal array<struct> column, parsed once from SQL text (building
    it value by value through the Python API costs a round trip per value)."""
    body = ", ".join("named_struct(" + ", ".join(f"'{k}', {sql_literal(v)}" for k, v in r.items()) + ")"
                     for r in rows)
    return F.expr(f"array({body})")


def config_table_expr(configs: list[tuple]) -> F.Column:
    """Literal array of config structs; tuples are (model, k, priming, ce, seed)."""
    return struct_array_expr([dict(zip(CONFIG_COLS, c)) for c in configs])


def config_tag(cfg: tuple) -> str:
    """'model|k|priming|ce|seed', the configuration part of a hash input."""
    m, k, p, ce, s = cfg
    return f"{m}|{k}|{p}|{str(ce).lower()}|{s}"


def explode_runs(df: DataFrame, configs: list[tuple], extra: dict | None = None) -> DataFrame:
    """One row per (row, run): adds a compact ``run_id`` plus per-run literal
    values (``extra`` maps a column name to a function of the config)."""
    extra = extra or {}
    rows = [{"run_id": i, **{name: fn(c) for name, fn in extra.items()}} for i, c in enumerate(configs)]
    return df.select("*", F.explode(struct_array_expr(rows)).alias("_r")).select(*df.columns, "_r.*")


def with_config(df: DataFrame, configs: list[tuple]) -> DataFrame:
    """Replace ``run_id`` by the configuration columns (a literal lookup)."""
    cfg = F.element_at(config_table_expr(configs), (F.col("run_id") + 1).cast("int"))
    return df.select(cfg.alias("_c"), *[c for c in df.columns if c != "run_id"]).select(
        *[F.col("_c." + c).alias(c) for c in CONFIG_COLS], *[c for c in df.columns if c != "run_id"])


ROWS_PER_PARTITION = 250_000  # (run, example) pairs per task after the grid explosion


def spread(examples: DataFrame, n_configs: int = 1, key: str = "uuid") -> DataFrame:
    """Hash-partition examples by ``key`` before they are multiplied.

    Exploding runs (or candidates) multiplies every row, so the input is
    spread first over enough partitions for the exploded volume: one per
    ROWS_PER_PARTITION output rows, at least one per core, at most 1024 per
    configured shuffle partition.  Partitioning on the example key also
    satisfies the later (run_id, key) window, aggregation and join, which
    then need no shuffle of their own.
    """
    spark = examples.sparkSession
    cores = spark.sparkContext.defaultParallelism
    cap = int(spark.conf.get("spark.sql.shuffle.partitions")) * 1024
    rows = row_count_at_most(examples, cap * ROWS_PER_PARTITION)
    n = min(cap, max(cores, math.ceil(rows * n_configs / ROWS_PER_PARTITION)))
    return examples.repartition(n, key)


def run_predictions(examples: DataFrame, candidates: DataFrame, vocab: DataFrame, configs: list[tuple],
                    logit_fn, extra: dict | None = None, k: int = 20, key: str = "eid",
                    example_cols: dict | None = None, candidate_cols: dict | None = None,
                    lists: bool = True) -> DataFrame:
    """Top-k predictions of every (run, example): run_id, the columns of
    ``examples``, preds, preds_l, probs.  An example whose relation has no
    allowed candidate has one row, without a run.  Without ``lists`` the rows
    have ``found`` in their place, the places and probabilities of the example's
    ``targets`` among its predictions, which is all that the metrics read.

    The runs are crossed with the *candidates* (bounded by the vocabulary,
    times the grid), not with the examples: ``candidates`` (rel, token, cnt)
    is exploded once per run with the ``extra`` per-run values, size-checked,
    gathered to one list for each relation and run and sent to the tasks, where
    an example is scored against each run's list and keeps its own columns:
    nothing is shuffled or joined back behind it.  ``example_cols``
    adds per-example columns (e.g. a hash of the uuid) and ``candidate_cols``
    per-(run, candidate) columns, each computed once on its own side;
    ``logit_fn(of)`` combines them, ``of`` giving by its name a column (in a
    join, where the candidates are too many to send) or a NumPy array, and the
    logit of a null is null.  ``key`` is a compact unique example id.
    """
    cands = explode_runs(sc.allowed_logits(candidates, vocab), configs, extra)
    for name, col in (candidate_cols or {}).items():
        cands = cands.withColumn(name, col)
    e = spread(examples, len(configs), key)
    for name, col in (example_cols or {}).items():
        e = e.withColumn(name, col)
    if bounded_broadcast(cands, MAX_CANDIDATES) is cands:
        logits = e.select(key, "rel", *(example_cols or {})).join(cands, "rel") \
            .select("run_id", key, "token", logit_fn(F.col).alias("logit"))
        top = sc.lowered(sc.topk_arrays(logits, None, k, ("run_id", key)).join(examples, key, "right"))
    else:
        top = sc.listed_topk_arrays(e, cands, logit_fn, [*(example_cols or {})], k, None if lists else "targets")
        if not lists:
            return top.select("run_id", *examples.columns, "found")
    return top.select("run_id", *examples.columns, "preds", "preds_l", "probs")


def run_metrics(preds: DataFrame, examples: DataFrame, targets: F.Column, configs: list[tuple],
                key: str = "eid") -> DataFrame:
    """``metrics_of_runs`` for predictions apart from their examples."""
    ex = examples.select(*dict.fromkeys([key, "uuid"]), "rel", targets.alias("targets"))
    return metrics_of_runs(preds.join(ex, key, "right"), configs)


def metrics_of_runs(rows: DataFrame, configs: list[tuple]) -> DataFrame:
    """Example metrics of every run, with its configuration columns, from rows
    of predictions that have their example's ``targets``.

    An example has predictions in every run or, when its relation has no
    allowed candidate, in none; then it scores 0 in every run.
    """
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(len(configs) - 1).cast("bigint"))
    run_ids = F.when(F.col("run_id").isNull(), every).otherwise(F.array(F.col("run_id").cast("bigint")))
    # the metrics first: they are few numbers to repeat, not lists
    return with_config(ev.example_metrics(rows).withColumn("run_id", F.explode(run_ids)), configs)


def summarize(metrics: DataFrame, relations: DataFrame | None, data: str, by: str = "type") -> DataFrame:
    """Summary rows (D15) per run: macro means over relations, total + slices."""
    rel = ev.relation_metrics(metrics, keys=tuple(CONFIG_COLS))
    return ev.macro_rollup(rel, relations, data, keys=tuple(CONFIG_COLS), by=by)


def upsert(old: DataFrame, new: DataFrame, key: list[str] = RUN_KEY, seq: str = "ingest_seq") -> DataFrame:
    """Append ``new`` to ``old`` and keep, per key, the row with the highest
    ingest sequence (the last written).  A grouped max_by combines map-side,
    so a key repeated in every batch costs one partial row per task."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(seq)).alias("_b")
    return both.groupBy(*key).agg(best).select(*key, *[F.col("_b." + c).alias(c) for c in rest])


def repair_priming_type(summary: DataFrame) -> DataFrame:
    """Old summaries carry ``use_natural_language`` instead of a priming type."""
    if "use_natural_language" not in summary.columns:
        return summary
    return summary.withColumn("priming_type", F.coalesce(
        F.col("priming_type"),
        F.when(F.col("use_natural_language"), F.lit("nl")).otherwise(F.lit("rarr"))))


# fixed values: token/target mismatch factors for generation models, BATS solvable share
T5_FACTORS = {"TREx": 0.7789, "ConceptNet": 0.379}
BATS_SOLVABLE_SHARE = 1522 / 2000


def adjust_p1(summary: DataFrame, adjust_bats: bool = False) -> DataFrame:
    """p_at_1 corrected for generation models (total rows of TREx and
    ConceptNet only) and, optionally, for BATS vocabulary coverage."""
    p = F.col("p_at_1")
    expr = None
    for data, f in T5_FACTORS.items():
        cond = F.col("model").startswith("t5") & (F.col("data") == data)
        expr = F.when(cond, p * f) if expr is None else expr.when(cond, p * f)
    if adjust_bats:
        expr = expr.when(F.col("data") == "BATS", p * BATS_SOLVABLE_SHARE)
    return summary.withColumn("p_at_1_adj", expr.otherwise(p))
