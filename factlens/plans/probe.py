"""Flagship chain: facts -> examples -> scores -> top-k -> metrics -> rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import evaluation as ev
from factlens.operators import examples as ex
from factlens.operators import scoring as sc
from factlens.plans import fixtures as fx
from factlens.plans import sqlparts as sq
from factlens.plans.common import rounded
from factlens.sources.tables import table_path
from factlens.store import stored

FACT_TABLES = ["nation", "region", "customer", "part", "supplier", "lineitem"]

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


class Probe:
    """The lazily built frames of one probe run over a scale-factor folder."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        inputs = [table_path(d, t) for t in FACT_TABLES]
        self.facts = stored(spark, "facts", inputs, lambda: fx.raw_facts(spark, d))
        self.relations = fx.relations(spark)
        self.vocab = stored(spark, "vocab", inputs, lambda: fx.vocab(spark, d, self.facts))
        self.filled = ex.fill_templates(self.facts, self.relations)
        self.dedup = ex.dedup_examples(self.filled)
        # eid: dense example id, fixed once the table is written (compact join/sort key)
        self.examples = stored(spark, "examples", inputs, lambda: ex.valid_examples(self.dedup, self.vocab)
                               .withColumn("eid", F.monotonically_increasing_id()))

    @property
    def bats(self) -> DataFrame:
        """The multi-answer examples, stored as the facts are."""
        return stored(self.spark, "bats", [table_path(self.d, t) for t in FACT_TABLES],
                      lambda: fx.bats_examples(self.spark, self.d, self.vocab))

    def topk(self, k: int = 20) -> DataFrame:
        logits = fx.count_scorer_logits(self.examples, self.facts)
        return sc.masked_topk(logits, self.vocab, k)

    def metrics(self) -> DataFrame:
        logits = fx.count_scorer_logits(self.examples, self.facts)
        preds = sc.lowered(sc.topk_arrays(logits, self.vocab)).drop("logits")
        j = self.examples.join(preds, "uuid", "left").withColumn("targets", F.array("y"))
        return ev.example_metrics(j)

    def relation_metrics(self) -> DataFrame:
        return ev.relation_metrics(self.metrics())

    def rollup(self) -> DataFrame:
        return ev.macro_rollup(self.relation_metrics(), self.relations, fx.DATASET)


BASE = [sq.RELATIONS_CTE, sq.RAW_FACTS_CTE, sq.VOCAB_CTE, sq.FILLED_CTE, sq.DEDUP_CTE]
FLAGSHIP = BASE + [sq.EXAMPLES_CTE, sq.LOGITS_CTE, sq.topk_ctes()]
METRICS_CTE = f"""metrics AS (
  SELECT e.uuid, e.rel, e.type,
  {sq.metric_exprs('p.preds', 'p.probs', '[e.y]')}
  FROM examples e LEFT JOIN preds p ON e.uuid = p.uuid
)"""
REL_METRICS_CTE = f"""rel_metrics AS (
  SELECT rel, {sq.avg_metrics()}, count(*) AS n_examples FROM metrics GROUP BY rel
)"""
MC = ", ".join(f"round({c}, 6) AS {c}" for c in sq.METRIC_COLS)


@register("template_fill", sq.with_(*BASE) + "SELECT uuid, rel, type, subj, y, x FROM filled")
def template_fill(spark, d):
    return Probe(spark, d).filled.select("uuid", "rel", "type", "subj", "y", "x")


@register("fact_dedup", sq.with_(*BASE) + "SELECT uuid, rel, type, subj, y, x FROM dedup")
def fact_dedup(spark, d):
    return Probe(spark, d).dedup.select("uuid", "rel", "type", "subj", "y", "x")


@register("example_filter", sq.with_(*BASE, sq.EXAMPLES_CTE) + "SELECT uuid, rel, type, subj, y, x FROM examples")
def example_filter(spark, d):
    return Probe(spark, d).examples.select("uuid", "rel", "type", "subj", "y", "x")


@register("masked_topk", sq.with_(*FLAGSHIP) +
          "SELECT uuid, CAST(rank AS BIGINT) AS rank, token, round(logit, 6) AS logit, round(prob, 6) AS prob FROM ranked")
def masked_topk(spark, d):
    t = Probe(spark, d).topk().select("uuid", F.col("rank").cast("bigint").alias("rank"), "token", "logit", "prob")
    return rounded(t, ["logit", "prob"])


@register("example_metrics", sq.with_(*FLAGSHIP, METRICS_CTE) +
          "SELECT uuid, rel, p_at_1, p_at_3, p_at_5, p_at_10, p_at_20, round(mrr, 6) AS mrr, "
          "round(target_likelihood, 6) AS target_likelihood FROM metrics")
def example_metrics(spark, d):
    m = Probe(spark, d).metrics().select("uuid", "rel", *ev.METRIC_COLS)
    return rounded(m, ["mrr", "target_likelihood"])


@register("relation_metrics", sq.with_(*FLAGSHIP, METRICS_CTE, REL_METRICS_CTE) +
          f"SELECT rel, {MC}, n_examples FROM rel_metrics")
def relation_metrics(spark, d):
    return rounded(Probe(spark, d).relation_metrics(), ev.METRIC_COLS)


MACRO_SQL = sq.with_(*FLAGSHIP, METRICS_CTE, REL_METRICS_CTE) + f"""
SELECT CASE WHEN grouping(r.type) = 1 THEN '{fx.DATASET}' ELSE '{fx.DATASET}_' || r.type END AS data,
       {", ".join(f"round(avg({c}), 6) AS {c}" for c in sq.METRIC_COLS)}, count(*) AS n_relations
FROM rel_metrics m LEFT JOIN relations r ON m.rel = r.rel
GROUP BY GROUPING SETS ((r.type), ())"""


@register("macro_rollup", MACRO_SQL)
def macro_rollup(spark, d):
    return rounded(Probe(spark, d).rollup(), ev.METRIC_COLS)
