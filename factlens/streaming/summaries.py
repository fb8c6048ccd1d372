"""Summary upsert as run files arrive (X2).

A file stream over the run store feeds a versioned summary store.  The
stream's checkpoint records which files were consumed, so a restart neither
skips nor repeats a run; the micro-batch id is the version, so a replayed
batch rewrites the same version instead of adding a new one.

Without ``row_key`` a batch holds whole runs, and a later batch replaces a
run.  With it (the column that names a run's rows, such as ``uuid``) a run may
arrive in any number of batches and rows may be replaced: ``transformWithState``
keeps each row's last metrics and emits the old ones as a retraction and the
new ones as an addition; a table of exact sums and counts for each run and
relation takes the differences up, and the touched runs' summaries follow from
it.  A batch costs its own rows and the table of sums; no run file is read
again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factlens.operators import evaluation as ev
from factlens.operators import runs as rn
from factlens.sources.files import upsert_summary
from factlens.streaming.state import rocksdb

_EXACT = "decimal(38,18)"
_WHOLE = 1_000_000
SUM_COLS = [f"sum_{m}" for m in ev.METRIC_COLS]
CHANGE_SCHEMA = ("model string, num_examples bigint, priming_type string, use_close_examples boolean, random_seed bigint, "
                 "rel string, sign int, m array<double>")


class LastRow(StatefulProcessor):
    """The last written metrics of one row of a run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, path string, rel string, m array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = max((int(r.at), r.path, r.rel, tuple(r.m)) for pdf in rows for r in pdf.itertuples(index=False))
        old = None
        if self.last.exists():
            at, path, rel, m = self.last.get()
            old = (at, path, rel, tuple(m))
        if old is not None and old[:2] > new[:2]:
            return
        self.last.update((new[0], new[1], new[2], list(new[3])))
        changes = [] if old is not None and old[2:] == new[2:] else [(1, new)] if old is None else [(-1, old), (1, new)]
        if changes:
            yield pd.DataFrame([(*key[:5], row[2], sign, list(row[3])) for sign, row in changes],
                               columns=["model", "num_examples", "priming_type", "use_close_examples", "random_seed", "rel", "sign", "m"])

    def close(self) -> None:
        pass


def row_changes(rows: DataFrame, row_key: str) -> DataFrame:
    """Streaming rows of runs (with ``at`` and ``path`` of their files) to
    signed rows: run columns, rel, sign (1 added, -1 retracted), m (metrics)."""
    metrics = F.array(*[F.col(c).cast("double") for c in ev.METRIC_COLS])
    keyed = rows.select(*rn.CONFIG_COLS, F.col(row_key).alias("row_key"), "at", "path", "rel", metrics.alias("m"))
    return keyed.groupBy(*rn.CONFIG_COLS, "row_key").transformWithStateInPandas(LastRow(), CHANGE_SCHEMA, "update", "none")


def run_sums(changes: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts for each run and relation (and each value of the columns
    ``apart``) from signed rows.  Decimal sums are exact, so a retraction takes
    away just what was added.  Whole numbers (hits and misses, most of what is
    summed) are summed as such, which is exact too and far cheaper."""
    sums, both = [], []
    for i, s in enumerate(SUM_COLS):
        x = F.get("m", F.lit(i))
        whole = (F.abs(x) <= _WHOLE) & (x == F.rint(x))
        sums += [F.sum(F.when(whole, x.cast("bigint") * F.col("sign"))).alias(f"_w{i}"),
                 F.sum(F.when(~F.coalesce(whole, F.lit(False)), x.cast(_EXACT) * F.col("sign").cast("decimal(1,0)"))).cast(_EXACT).alias(f"_d{i}")]
        # of a width whose sum keeps all 18 digits
        added = F.col(f"_d{i}").cast("decimal(37,18)") + F.col(f"_w{i}").cast("decimal(19,0)")
        both.append(F.coalesce(added.cast(_EXACT), F.col(f"_d{i}"), F.col(f"_w{i}").cast(_EXACT)).alias(s))
    keys = [*apart, *rn.CONFIG_COLS, "rel"]
    return changes.groupBy(*keys).agg(F.sum("sign").cast("bigint").alias("n"), *sums).select(*keys, "n", *both)


def merge_sums(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Two tables of sums as one; runs and relations without rows go."""
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*rn.CONFIG_COLS, "rel").agg(
        F.sum("n").alias("n"), *[F.sum(s).cast(_EXACT).alias(s) for s in SUM_COLS]).filter(F.col("n") > 0)


def summary_of_sums(sums: DataFrame, relations: DataFrame | None, data: str, by: str = "type") -> DataFrame:
    means = [(F.col(s).cast("double") / F.col("n")).alias(m) for m, s in zip(ev.METRIC_COLS, SUM_COLS, strict=True)]
    rel = sums.select(*rn.CONFIG_COLS, "rel", *means, F.col("n").alias("n_examples"))
    return ev.macro_rollup(rel, relations, data, keys=tuple(rn.CONFIG_COLS), by=by)


def _same_run(a: DataFrame, b: DataFrame):
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b["_" + c]) for c in rn.CONFIG_COLS])


def start_summary_stream(spark: SparkSession, runs_path: str, schema: str, relations: DataFrame,
                         data: str, summary_root: str, checkpoint: str, by: str = "type", row_key: str | None = None):
    """Start the stream; returns the StreamingQuery."""
    stream = spark.readStream.schema(schema).parquet(runs_path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_summary(batch.sparkSession, rn.summarize(batch, relations, data, by=by), summary_root, version=int(batch_id) + 1)

    def merge_changes(batch: DataFrame, batch_id: int) -> None:
        session, version = batch.sparkSession, int(batch_id) + 1
        changed = run_sums(batch).checkpoint()
        root = summary_root.rstrip("/") + "-sums"
        old = session.read.parquet(f"{root}/version={version - 1}") if version > 1 else None
        merge_sums(old, changed).write.mode("overwrite").parquet(f"{root}/version={version}")
        sums = session.read.parquet(f"{root}/version={version}")
        touched = changed.select(*[F.col(c).alias("_" + c) for c in rn.CONFIG_COLS]).distinct()
        new = summary_of_sums(sums.join(touched, _same_run(sums, touched), "left_semi"), relations, data, by)
        upsert_summary(session, new, summary_root, version=version)

    if row_key is None:
        return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    written = stream.select("*", F.unix_micros("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"))
    with rocksdb(spark):
        return (row_changes(written, row_key).writeStream.outputMode("update").foreachBatch(merge_changes)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
