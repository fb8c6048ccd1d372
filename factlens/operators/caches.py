"""Caches kept by key, extended by what is missing.

A cache is a folder of numbered parts (``part=0``, ``part=1``, ...), each
written under a name of its own and renamed when it is complete, so a reader
sees whole parts only and a lost job leaves nothing behind that counts.
Missing keys are found by an anti-join; work is in proportion to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import neighbours as nb
from factlens.operators.scoring import score_prompts
from factlens.store import _file_system


def parts(spark: SparkSession, root: str) -> list[str]:
    """Paths of the complete parts of a cache, oldest first."""
    path, fs = _file_system(spark, root)
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part=")]
    return [f"{root.rstrip('/')}/{p.getName()}" for p in sorted(found, key=lambda p: int(p.getName()[5:]))]


def publish(df: DataFrame, root: str) -> str:
    """Write ``df`` as the next part of a cache."""
    spark = df.sparkSession
    own = f"{root.rstrip('/')}/_{uuid.uuid4().hex}"
    df.write.parquet(own)
    while True:
        path = f"{root.rstrip('/')}/part={len(parts(spark, root))}"
        target, fs = _file_system(spark, path)
        if not fs.exists(target) and fs.rename(_file_system(spark, own)[0], target):
            return path


def cached_scores(prompts: DataFrame, root: str, scorer_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  text_col: str = "x_primed", key_col: str = "uuid") -> DataFrame:
    """``key_col, token, logit`` of every prompt by a cache of scored texts.

    A text is scored once, whatever the number of prompts that have it, and
    again only if it never was; a text without scores is remembered too.
    ``scorer_factory`` is that of ``score_prompts`` and has to give the same
    scores for the same text."""
    spark = prompts.sparkSession
    texts = prompts.select(F.sha2(text_col, 256).alias("text_key"), F.col(text_col).alias(text_col)).dropDuplicates(["text_key"])
    had = parts(spark, root)
    missing = texts.join(spark.read.parquet(*had).select("text_key"), "text_key", "left_anti") if had else texts
    scored = score_prompts(missing, scorer_factory, "text_key string, token string, logit double", text_col, "text_key")
    lists = scored.groupBy("text_key").agg(F.collect_list(F.struct("token", "logit")).alias("scores"))  # one text's candidates
    publish(missing.select("text_key").join(lists, "text_key", "left"), root)
    known = spark.read.parquet(*parts(spark, root))
    keyed = prompts.select(key_col, F.sha2(text_col, 256).alias("text_key"))
    return keyed.join(known, "text_key").select(key_col, F.inline("scores"))


def cached_topk(vectors: DataFrame, root: str, k: int = 301, id_col: str = "id", vec_col: str = "vec", **options) -> DataFrame:
    """The neighbour index of ``vectors`` by a cache: the newest part holds the
    vectors and lists of all subjects so far; new ids extend it, without any it
    is read as it is.  Vectors of known ids have to be the same."""
    spark = vectors.sparkSession
    had = parts(spark, root)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    if had:
        old = spark.read.parquet(had[-1])
        subjects, lists = old.select("id", "vec"), old.select(F.col("id").alias("i"), F.inline("near"))
        new = v.join(subjects.select("id"), "id", "left_anti")
        if new.isEmpty():
            return lists
        topk = nb.extend_topk(lists, subjects, new, k, **options)
        v = subjects.unionByName(new)
    else:
        topk = nb.projection_topk(v, k, **options)
    lists = topk.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "sim"))).alias("near"))  # k rows at most
    path = publish(v.join(lists, v["id"] == lists["i"]).select(
        "id", "vec", F.transform("near", lambda x: F.struct(x["j"].alias("j"), x["rank"].alias("rank"), x["sim"].alias("sim"))).alias("near")), root)
    return spark.read.parquet(path).select(F.col("id").alias("i"), F.inline("near"))
