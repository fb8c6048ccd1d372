"""Normalisers from raw LAMA-style rows to probe examples, one per dataset,
and the dispatch between them (the BATS reader is in sources.files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.operators.examples import fill_templates
from factlens.operators.prompts import sentence_by_suffix

# fixed values: Google-RE relations and their cloze sentences
GOOGLE_RE_TEMPLATES = [
    ("place_of_birth", "{} was born in [MASK]."),
    ("date_of_birth", "{} (born [MASK])."),
    ("place_of_death", "{} died in [MASK]."),
]
DATASETS = ("TREx", "ConceptNet", "Google_RE")


def trex_examples(raw: DataFrame, relations: DataFrame) -> DataFrame:
    """TREx rows (predicate_id, sub_label, obj_label, uuid): template filled."""
    f = raw.select(F.col("predicate_id").alias("rel"), F.col("sub_label").alias("subj"),
                   F.col("obj_label").alias("obj"), "uuid")
    return fill_templates(f, relations)


def conceptnet_examples(raw: DataFrame) -> DataFrame:
    """ConceptNet rows: all masked sentences joined by a space; the subject
    is ``sub`` when present, else ``sub_label``."""
    subj = F.coalesce(F.col("sub"), F.col("sub_label")) if "sub" in raw.columns else F.col("sub_label")
    return raw.select("uuid", F.col("pred").alias("rel"), subj.alias("subj"), F.col("obj_label").alias("y"),
                      F.array_join("masked_sentences", " ").alias("x"))


def google_re_examples(raw: DataFrame) -> DataFrame:
    """Google-RE rows: a fixed sentence chosen by the predicate's last path
    part (an unknown predicate is an error)."""
    return raw.select("uuid", F.col("pred").alias("rel"), F.col("sub_label").alias("subj"),
                      F.col("obj_label").alias("y"),
                      sentence_by_suffix(F.col("pred"), F.col("sub_label"), GOOGLE_RE_TEMPLATES).alias("x"))


def load_examples(identifier: str, raw: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Dispatch on the dataset name (Squad has no normaliser, as in the reference)."""
    if identifier == "TREx":
        return trex_examples(raw, relations)
    if identifier == "ConceptNet":
        return conceptnet_examples(raw)
    if identifier == "Google_RE":
        return google_re_examples(raw)
    raise ValueError(f"no normaliser for dataset {identifier!r}")


def uses_shared_vocab(model: str, requested: bool = True) -> bool:
    """The shared vocabulary applies to cased and albert models only."""
    return requested and ("-cased" in model or "albert" in model)


def vocab_for_model(vocab: DataFrame, model: str) -> DataFrame:
    """albert and uncased models see the lower-cased vocabulary."""
    if "albert" in model or "-uncased" in model:
        return vocab.select(F.lower("token").alias("token")).distinct()
    return vocab
