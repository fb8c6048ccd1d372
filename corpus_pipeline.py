"""Corpus pipeline: the stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes every stage's result as Parquet under
``spark.checkpoint.dir`` and reads it again as the next one's documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.llm import bpe, decontam, langid, line_dedup, simhash
from factlens.llm.common import documents, written
from factlens.llm.queries import VOCABULARY

#: Language identification has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter,
    whether or not any document has a label to learn from."""
    model = langid.train(docs.filter(~langid.held_out("doc_id")), "text", "lang", F.col("doc_id"))
    # a model without labels knows no language: then the texts decide by themselves
    known = F.col("lang_pred") != langid.UNKNOWN if model.labels else langid.has_letter("text")
    return langid.predict(docs, model).filter(known).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document that loses all its
    lines goes.  ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs).filter(F.col("text").isNotNull())
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays;
    rows that repeat its id and text count once."""
    found = simhash.near_duplicates(docs)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    once = Window.partitionBy("doc_id", "_h").orderBy("source", "lang", "n_chars")
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")), "left_semi").withColumn("_h", F.xxhash64("text")) \
        .withColumn("_n", F.row_number().over(once)).filter(F.col("_n") == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.contamination(docs, items).filter(F.col("n_hit") == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, see ``bpe.id_array``), and whether they decode to the text."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    done = bpe.round_trip(docs, path, pattern)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_stage),
    ("decontamination", decontamination),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
