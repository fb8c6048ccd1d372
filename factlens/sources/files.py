"""Readers and writers for the reference's on-disk formats.

Every reader returns a lazy DataFrame with a declared schema; file paths
come from the ``_metadata`` column, so order, categories and run keys are
derived by Spark rather than by listing files on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from factlens.functions import parsing as ps
from factlens.operators.runs import RUN_KEY, upsert
from factlens.session import bounded_broadcast, ensure_checkpoint_dir
from factlens.store import persisted

LAMA_SCHEMA = ("uuid string, predicate_id string, pred string, sub string, sub_label string, obj_label string, "
               "masked_sentences array<string>")
RELATION_SCHEMA = "relation string, template string, type string"
SUMMARY_SCHEMA = ("data string, `p@1` double, `p@3` double, `p@5` double, `p@10` double, `p@20` double, mrr double, "
                  "target_likelihood double, model string, num_examples bigint, priming_type string, "
                  "use_close_examples boolean, random_seed bigint")
GLOVE_DENOMINATOR = 667
MAX_SPLITS = 1_000_000
RUN_KEY_SCHEMA = ("data string, model string, num_examples bigint, priming_type string, use_close_examples boolean, "
                  "random_seed bigint")
# fixed values: columns of a prediction file
RUN_COLUMNS = ["_index", "uuid", "rel", "subj", "x", "y", "x_primed", "y_pred", "y_pred_prob"]
MAX_CSV_FIELDS = 64
# run files only: other CSVs in the folder (a summary) must not even be scanned,
# since the first file's header would define the schema of all of them
RUN_FILE_GLOB = "pe-*_nl-*_ce-*_rs-*.csv"
BATS_FILE_ROWS = 50


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (one object per line) with a declared schema, plus the
    source file (S1, S3: a folder reads every file in it)."""
    return spark.read.schema(schema).json(path).withColumn("file_path", F.col("_metadata.file_path"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small text files with their 0-based line number within the
    file, each file read whole (see ``numbered_lines``)."""
    t = spark.read.text(path, wholetext=True).select(F.url_decode(F.col("_metadata.file_path")).alias("file_path"), "value")
    lines = F.split(F.regexp_replace("value", "\n\\z", ""), "\n")
    return t.select("file_path", F.posexplode(lines).alias("line_no", "line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``read_lines`` for files of any size: a file is read in splits, as Spark
    cuts it, and a line's number is its place in the split plus the lines of
    the file's earlier splits (one count a split).  An empty file has no line."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.url_decode(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = persisted(text.groupBy("file_path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "splits")
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file_path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return text.join(bounded_broadcast(base, MAX_SPLITS), ["file_path", "block"]).select(
        "file_path", (F.col("at") + F.col("base")).cast("int").alias("line_no"), "line")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relation metadata; a relation listed twice keeps its last line (S2)."""
    lines = numbered_lines(spark, path).filter(F.length("line") > 0)
    rel = lines.select("file_path", "line_no", F.from_json("line", RELATION_SCHEMA).alias("r"))
    best = rel.groupBy(F.col("r.relation").alias("rel")).agg(
        F.max_by("r", F.struct("file_path", "line_no")).alias("r"))
    return best.select("rel", F.col("r.template").alias("template"), F.col("r.type").alias("type"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """One token per line; only the line break is removed (S6)."""
    return spark.read.text(path).select(F.col("value").alias("token"))


def read_bats(spark: SparkSession, root: str) -> DataFrame:
    """BATS category files ``<root>/<dir>/<CAT name>.txt``: ``x<TAB>y1/y2``;
    category = first word of the file name, uuid = category_line (S5, P4)."""
    lines = numbered_lines(spark, root.rstrip("/") + "/*/*.txt").filter(F.length("line") > 0)
    name = F.element_at(F.split("file_path", "/"), -1)
    cat = F.element_at(F.split(name, " "), 1)
    parts = F.split("line", "\t")
    return lines.select(cat.alias("rel"), F.element_at(parts, 1).alias("x"), F.element_at(parts, 1).alias("subj"),
                        F.split(F.element_at(parts, 2), "/").alias("answers"),
                        F.concat_ws("_", cat, F.col("line_no").cast("string")).alias("uuid"))


def read_category_names(spark: SparkSession, root: str) -> DataFrame:
    """Category code -> full file stem, from the folder listing (S15)."""
    # the listing alone: no file is opened
    lines = spark.read.format("binaryFile").load(root.rstrip("/") + "/*/*.txt") \
        .select(F.element_at(F.split("path", "/"), -1).alias("f"))
    stem = F.regexp_replace(F.url_decode("f"), r"\.[^.]*$", "")
    return lines.select(F.element_at(F.split(stem, " "), 1).alias("category"), stem.alias("name"))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every prediction CSV below ``root`` whose path is a run path, with the
    run key parsed from the path and list literals parsed to arrays
    (S7, S8, S9, S10).  Other files (a summary kept in the same folder)
    are ignored.  Adds ``parse_failed`` for literals that did not parse.

    The columns are ``RUN_COLUMNS`` whatever a file has: each file's own first
    record names its fields (files differ by the options of their runs), other
    fields are left out and absent ones are null."""
    fields = [f"c{i}" for i in range(MAX_CSV_FIELDS)]
    raw = (spark.read.schema(", ".join(f"{c} string" for c in fields)).option("multiLine", True).option("escape", '"')
           .option("recursiveFileLookup", True).option("pathGlobFilter", RUN_FILE_GLOB).csv(root))
    raw = raw.select(F.url_decode(F.col("_metadata.file_path")).alias("file_path"), F.monotonically_increasing_id().alias("at"),
                     F.array(*fields).alias("v")).filter(ps.is_run_path(F.col("file_path")))
    heads = persisted(raw.groupBy("file_path").agg(F.min("at").alias("first"), F.min_by("v", "at").alias("names")), "headers")
    rows = raw.join(bounded_broadcast(heads, MAX_SPLITS), "file_path").filter(F.col("at") != F.col("first"))
    place = {c: F.array_position("names", F.lit(c)).cast("int") for c in RUN_COLUMNS}
    df = rows.select("file_path", *[F.when(place[c] > 0, F.get("v", place[c] - 1)).alias(c) for c in RUN_COLUMNS])
    out = df.select("*", *ps.run_key(F.col("file_path")))
    y = F.when(F.col("y").startswith("["), ps.parse_list_literal(F.col("y"))).otherwise(F.array(F.col("y")))
    lists = {"y_pred": ps.parse_list_literal(F.col("y_pred")), "y_pred_prob": ps.parse_list_literal(F.col("y_pred_prob"), "double")}
    failed = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & lists[c].isNull() for c in lists])
    return out.withColumn("parse_failed", failed).withColumn("targets", y).withColumns(lists)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Summary CSV with its declared schema; 'p@k' columns renamed p_at_k (S11)."""
    df = spark.read.schema(SUMMARY_SCHEMA).option("header", True).csv(path)
    for k in (1, 3, 5, 10, 20):
        df = df.withColumnRenamed(f"p@{k}", f"p_at_{k}")
    return df


def read_episode_log(spark: SparkSession, path: str) -> DataFrame:
    """key:value episode lines with typed number fields (S12)."""
    m = ps.parse_kv_line(F.col("value"))
    return spark.read.text(path).select(
        m["games"].alias("games"), m["agent"].alias("agent"), m["lm"].alias("lm"),
        m["priming_template"].alias("priming_template"),
        m["num_priming_examples"].cast("bigint").alias("num_priming_examples"),
        m["score"].cast("double").alias("score"), m["steps"].cast("double").alias("steps"))


def read_baseline_counts(spark: SparkSession, path: str) -> DataFrame:
    """'category hits' lines to (category, p_at_1 = hits / 667) (S13)."""
    p = F.split(F.trim("value"), " +")
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(
        F.element_at(p, 1).alias("category"), (F.element_at(p, 2).cast("double") / GLOVE_DENOMINATOR).alias("p_at_1"))


def read_solvable(spark: SparkSession, path: str) -> DataFrame:
    """'category<TAB>count' to (category, share = count / 50) (S14)."""
    df = spark.read.schema("category string, n bigint").option("sep", "\t").csv(path)
    return df.select("category", (F.col("n") / F.lit(float(BATS_FILE_ROWS))).alias("share"))


# ------------------------------------------------------------------ sinks
def write_predictions(df: DataFrame, path: str) -> None:
    """Run predictions partitioned by run key (K1): a run is a folder, and a
    reader filtering on the key prunes the others.  A run that is written
    again replaces itself and leaves the other runs alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEY).parquet(path)


def read_predictions(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The prediction store by a declared schema: ``columns`` (SQL types) and
    the run key."""
    return spark.read.schema(f"{columns}, {RUN_KEY_SCHEMA}").parquet(path)


def write_solvable(df: DataFrame, path: str) -> None:
    """(rel, n_solvable) as tab-separated lines (K2)."""
    df.select("rel", "n_solvable").write.mode("overwrite").option("sep", "\t").csv(path)


def append_episode_log(df: DataFrame, path: str) -> None:
    """Append episode rows (K6)."""
    df.write.mode("append").parquet(path)


def latest_summary(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version of a summary store, or None if there is none."""
    try:
        versions = spark.read.parquet(root)
    except AnalysisException:
        return None
    last = versions.agg(F.max("version").alias("v"))  # one row
    return versions.join(F.broadcast(last), F.col("version") == F.col("v"), "left_semi").drop("version")


def upsert_summary(spark: SparkSession, new: DataFrame, root: str, version: int) -> DataFrame:
    """Append summary rows and keep the last row per run key (K3).

    Each call writes a complete version under ``root/version=N``; older
    versions stay readable, so a failed job never leaves a half-written
    summary.  The merge is checkpointed (reliable storage) before the
    version folder is written, so rewriting the same version (a replayed
    stream batch) never reads the files it replaces, and gives the same rows.
    """
    ensure_checkpoint_dir(spark)
    seq = F.lit(version).cast("bigint")
    old = latest_summary(spark, root)
    if old is not None:
        old = old.filter(F.col("ingest_seq") < version) if "ingest_seq" in old.columns else old
    new = new.withColumn("ingest_seq", seq)
    merged = (new if old is None else upsert(old, new)).checkpoint()
    merged.write.mode("overwrite").parquet(f"{root.rstrip('/')}/version={version}")
    return latest_summary(spark, root)
