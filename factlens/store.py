"""Derived tables written once to the shared checkpoint folder.

Several queries start from the same derived tables (facts, examples, run
predictions).  Writing them once as parquet under ``spark.checkpoint.dir``
cuts the lineage (a lost executor re-reads files instead of recomputing
joins) and lets later queries read instead of recompute, the way the
reference's reports read one summary file.

The table name carries a fingerprint of the library code and of the input
files, so a changed input or a changed rule never reuses an old table.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from factlens.session import ensure_checkpoint_dir

_PKG = os.path.dirname(os.path.abspath(__file__))


def _code_fingerprint() -> str:
    h = hashlib.md5()
    for root, _, files in sorted(os.walk(_PKG)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(root, f), "rb") as fh:
                    h.update(f.encode() + fh.read())
    return h.hexdigest()[:10]


CODE_FINGERPRINT = _code_fingerprint()


def _file_system(spark: SparkSession, path: str):
    """Hadoop path and its file system (local, shared or remote alike)."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Name, size and modification time of every file of the inputs."""
    h = hashlib.md5()
    for p in sorted(paths):
        h.update(p.encode())
        path, fs = _file_system(spark, p)
        if fs.exists(path):
            files, seen = fs.listFiles(path, True), []
            while files.hasNext():
                f = files.next()
                seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
            h.update("\n".join(sorted(seen)).encode())
    return h.hexdigest()[:10]


def persisted(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under a name of its own in the checkpoint folder and
    read again, so that all its uses see the same rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/factlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, inputs: list[str], build) -> DataFrame:
    """Read table ``name`` from the store, building it first if it isn't there
    in full.  A build is written under a name of its own and renamed when it is
    complete; a folder without ``_SUCCESS`` is set aside, and of two builders the first wins."""
    key = f"{name}-{CODE_FINGERPRINT}-{input_fingerprint(spark, inputs)}"
    path = ensure_checkpoint_dir(spark).rstrip("/") + "/factlens-store/" + key
    target, fs = _file_system(spark, path)
    done, _ = _file_system(spark, path + "/_SUCCESS")
    if not fs.exists(done):
        own = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(own)
        if fs.exists(target) and not fs.exists(done):
            fs.rename(target, _file_system(spark, f"{own}-incomplete")[0])
        if fs.exists(done) or not fs.rename(_file_system(spark, own)[0], target):
            return spark.read.parquet(path if fs.exists(done) else own)
    return spark.read.parquet(path)
