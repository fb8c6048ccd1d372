"""Belief updates from a stream of attempts (X1).

State per (scene, obj) is what the closed form needs: a map of the tried
containers and the latest successful attempt, kept by ``transformWithState``
in RocksDB (checkpointed, so a lost executor or a restart resumes from the
last committed micro-batch).  A trigger reads and writes only the map entries
of its own containers.  The state may start from a batch table of attempts
(``initial_state``) and may be forgotten some time after its last change
(``ttl_seconds``, for scenes that have ended).  Attempts may come late or
twice: both parts of the state only grow towards the maximum.

Each trigger emits the updated rows; ``beliefs_from_state`` turns the latest
snapshot plus the prior into the belief matrix (the same rule as the batch
``update``).  Snapshots are a log of one folder a batch, folded now and then
into a compacted table, so that a reader never reads the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factlens.store import _file_system
from factlens.streaming.state import rocksdb

OUTPUT_SCHEMA = ("scene long, obj string, tried array<string>, stored_in string, stored_ts long, "
                 "stored_id long, n_attempts long")


class BeliefState(StatefulProcessor):
    """State of one (scene, obj): tried containers, latest successful attempt."""

    def __init__(self, ttl_seconds: int | None = None):
        self.ttl = None if ttl_seconds is None else 1000 * ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tried = handle.getMapState("tried", "container string", "ts long", self.ttl)
        self.stored = handle.getValueState("stored", "ts long, id long, container string", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            for container in row.tried:
                self.tried.updateValue((container,), (0,))
            if row.stored_in is not None and not pd.isna(row.stored_ts):
                self.stored.update((int(row.stored_ts), int(row.stored_id), row.stored_in))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last, seen = 0, None, {}
        for pdf in rows:
            n += len(pdf)
            for container, ts in pdf.groupby("container")["ts_us"].max().items():
                seen[container] = max(seen.get(container, ts), ts)
            ok = pdf[pdf["success"]]
            if len(ok):
                top = ok.sort_values(["ts_us", "event_id"]).iloc[-1]
                last = max(last or (-1 << 63, 0, ""), (int(top["ts_us"]), int(top["event_id"]), top["container"]))
        for container, ts in seen.items():
            self.tried.updateValue((container,), (int(ts),))
        stored = tuple(self.stored.get()) if self.stored.exists() else None
        if last is not None and (stored is None or last[:2] > stored[:2]):
            self.stored.update(last)
            stored = last
        ts, event, container = stored or (None, None, None)
        tried = sorted(k[0] for k in self.tried.keys())
        yield pd.DataFrame({"scene": [key[0]], "obj": [key[1]], "tried": [tried], "stored_in": [container],
                            "stored_ts": pd.array([ts], "Int64"), "stored_id": pd.array([event], "Int64"), "n_attempts": [n]})

    def close(self) -> None:
        pass


def _attempts(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("scene", "obj", "container", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                           "event_id", "success")


def initial_state(outcomes: DataFrame) -> DataFrame:
    """State of a batch table of attempts, for a stream to go on from."""
    at = F.when(F.col("success"), F.struct("ts_us", "event_id", "container"))
    return _attempts(outcomes).groupBy("scene", "obj").agg(
        F.array_sort(F.collect_set("container")).alias("tried"), F.max(at).alias("s")).select(
        "scene", "obj", "tried", F.col("s.container").alias("stored_in"), F.col("s.ts_us").alias("stored_ts"),
        F.col("s.event_id").alias("stored_id"))


def belief_state_stream(outcomes: DataFrame, initial: DataFrame | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """``outcomes``: a streaming frame of (scene, obj, container, ts,
    event_id, success).  Returns the per-key state snapshots (update mode)."""
    return _attempts(outcomes).groupBy("scene", "obj").transformWithStateInPandas(
        BeliefState(ttl_seconds), OUTPUT_SCHEMA, "update", "none" if ttl_seconds is None else "processingTime",
        None if initial is None else initial.groupBy("scene", "obj"))


def _folders(spark: SparkSession, path: str, column: str) -> dict[int, str]:
    """Complete folders ``column=n`` of ``path`` by number."""
    at, fs = _file_system(spark, path)
    if not fs.exists(at):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    found = {int(n.split("=")[1]): f"{path}/{n}" for n in names if n.startswith(f"{column}=")}
    return {n: p for n, p in found.items() if fs.exists(_file_system(spark, f"{p}/_SUCCESS")[0])}


def start_belief_stream(outcomes: DataFrame, snapshot_path: str, checkpoint: str, trigger: dict | None = None,
                        initial: DataFrame | None = None, ttl_seconds: int | None = None, compact_every: int = 20):
    """Run the state stream, writing each micro-batch's updated keys to a
    folder of its own (a replayed batch replaces it by the same rows) and
    folding the log every ``compact_every`` batches."""
    root = snapshot_path.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={int(batch_id)}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, root, int(batch_id))

    stream = belief_state_stream(outcomes, initial, ttl_seconds)
    w = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    with rocksdb(outcomes.sparkSession):
        return w.start()


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Keep the newest snapshot per key from the append-only snapshot log."""
    cols = [c for c in snapshots.columns if c != "batch_id"]
    return snapshots.groupBy("scene", "obj").agg(
        F.max_by(F.struct(*cols), F.col("batch_id")).alias("s")).select("s.*")


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Fold the log up to batch ``upto`` into the compacted table beside it."""
    snapshots(spark, root, upto).write.mode("overwrite").parquet(f"{root.rstrip('/')}-compact/upto={upto}")


def snapshots(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The newest snapshot per key (with ``batch_id``): the compacted table and
    the batches after it."""
    root = root.rstrip("/")
    batches = {n: p for n, p in _folders(spark, root, "batch_id").items() if upto is None or n <= upto}
    bases = {n: p for n, p in _folders(spark, f"{root}-compact", "upto").items() if upto is None or n < upto}
    base = max(bases, default=-1)
    found = [spark.read.parquet(bases[base])] if bases else []
    found += [spark.read.parquet(p).withColumn("batch_id", F.lit(n).cast("bigint")) for n, p in sorted(batches.items()) if n > base]
    if not found:
        return spark.createDataFrame([], OUTPUT_SCHEMA + ", batch_id long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    cols = every.columns
    return every.groupBy("scene", "obj").agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select("s.*")


def beliefs_from_state(prior: DataFrame, state: DataFrame) -> DataFrame:
    """Belief matrix from the prior (scene, obj, container, p) and the state
    snapshot: one-hot at the stored container, else tried cells zeroed and
    the row renormalised (NULL when nothing remains), else the prior."""
    s = state.select("scene", "obj", "tried", "stored_in")
    j = prior.join(s, ["scene", "obj"], "left")
    is_tried = F.coalesce(F.array_contains("tried", F.col("container")), F.lit(False))
    w = Window.partitionBy("scene", "obj")
    remaining = F.sum(F.when(is_tried, F.lit(0.0)).otherwise(F.col("p"))).over(w)
    any_tried = F.coalesce(F.size("tried"), F.lit(0)) > 0
    p = (F.when(F.col("stored_in").isNotNull(),
                F.when(F.col("container") == F.col("stored_in"), F.lit(1.0)).otherwise(F.lit(0.0)))
          .when(any_tried, F.when(remaining > 0, F.when(is_tried, F.lit(0.0)).otherwise(F.col("p") / remaining)))
          .otherwise(F.col("p")))
    state_col = F.when(F.col("stored_in").isNotNull(), F.lit("stored")).when(any_tried, F.lit("updated")) \
                 .otherwise(F.lit("prior"))
    return j.select("scene", "obj", "container", p.alias("p"), state_col.alias("state"))
