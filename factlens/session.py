"""Session helpers: building a session, the checkpoint folder, guarded broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "factlens", extra: dict | None = None) -> SparkSession:
    """Session for tests, benches and local runs. On a cluster, use the
    cluster's own session and leave its settings alone."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session names none (local tests) is a scratch folder set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="factlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


_ROW_BOUNDS: dict = {}


def row_count_at_most(df: DataFrame, max_rows: int) -> int:
    """min(row count, max_rows + 1), counted in parallel (one partial count per
    task) and remembered per session and plan, so a table checked once is not
    re-counted by later operators."""
    key = (id(df.sparkSession), df.semanticHash(), df.schema.simpleString(), max_rows)
    n = _ROW_BOUNDS.get(key)
    if n is None:
        n = min(df.count(), max_rows + 1)
        _ROW_BOUNDS[key] = n
    return n


_SIZES: dict = {}
MAX_BROADCAST_BYTES = 256 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: strings by length, other plain values 8, nested ones as JSON."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        col, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(col), F.lit(0)) + 8
        elif kind in ("array", "map", "struct"):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 8
        else:
            total += F.lit(8)
    return total


def rows_and_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``df``, summed in parallel and remembered per session
    and plan."""
    key = (id(df.sparkSession), df.semanticHash(), df.schema.simpleString())
    if key not in _SIZES:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).first()
        _SIZES[key] = (r["n"], r["b"])
    return _SIZES[key]


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows and
    ``max_bytes`` bytes.

    The proof is ``rows_and_bytes``.  Above either bound the frame is
    returned unchanged and the join planner (with AQE skew handling)
    shuffles it.
    """
    rows, size = rows_and_bytes(df)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def literal_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a table built from a Python literal on the driver (its size
    is the literal's, known by construction)."""
    return F.broadcast(df)
