"""Run-path keys, list literals and key:value episode logs, on data rendered
from the test tables (so that a parse can be checked against the source)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.functions import parsing as ps
from factlens.functions.text import words
from factlens.plans import sqlparts as sq
from factlens.plans.common import rounded
from factlens.sources.tables import spread, table

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


DATAS = ["TREx", "Google_RE", "ConceptNet", "BATS"]
MODELS = ["bert-base-cased", "bert-large-cased", "albert-xxlarge-v2", "t5-large"]
NLS = ["nl", "rarr", "Rarr", "par", "True", "False"]


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def run_paths(spark, d):
    """A results folder listing: one run file per order, plus a summary file
    for pending orders (which must not be taken for a run)."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    run = F.concat(F.lit("out/results/"), _pick(DATAS, F.pmod(k, F.lit(4))), F.lit("/"),
                   _pick(MODELS, F.pmod(c, F.lit(4))), F.lit("/pe-"), F.pmod(k, F.lit(21)).cast("string"),
                   F.lit("_nl-"), _pick(NLS, F.pmod(c, F.lit(6))),
                   F.lit("_ce-"), F.when(F.pmod(k, F.lit(2)) == 0, F.lit("True")).otherwise(F.lit("False")),
                   F.lit("_rs-"), F.pmod(c, F.lit(8)).cast("string"), F.lit(".csv"))
    path = F.when(F.col("o_orderstatus") == "P", F.lit("out/results/summary.csv")).otherwise(run)
    return o.select("o_orderkey", path.alias("path"))


def _sql_pick(values, idx):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{idx} + 1]"


RUN_PATH_SQL = f"""WITH p AS (
  SELECT o_orderkey,
    CASE WHEN o_orderstatus = 'P' THEN 'out/results/summary.csv' ELSE
      'out/results/' || {_sql_pick(DATAS, 'o_orderkey % 4')} || '/' || {_sql_pick(MODELS, 'o_custkey % 4')}
      || '/pe-' || CAST(o_orderkey % 21 AS VARCHAR) || '_nl-' || {_sql_pick(NLS, 'o_custkey % 6')}
      || '_ce-' || CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END
      || '_rs-' || CAST(o_custkey % 8 AS VARCHAR) || '.csv' END AS path
  FROM orders
)
SELECT o_orderkey, regexp_extract(path, '{ps.RUN_PATH_PATTERN}', 1) AS data,
  regexp_extract(path, '{ps.RUN_PATH_PATTERN}', 2) AS model,
  CAST(regexp_extract(path, '{ps.RUN_PATH_PATTERN}', 3) AS BIGINT) AS num_examples,
  CASE regexp_extract(path, '{ps.RUN_PATH_PATTERN}', 4) """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ps.LEGACY_PRIMING.items()) + f""" END AS priming_type,
  regexp_extract(path, '{ps.RUN_PATH_PATTERN}', 5) = 'True' AS use_close_examples,
  CAST(regexp_extract(path, '{ps.RUN_PATH_PATTERN}', 6) AS BIGINT) AS random_seed
FROM p WHERE regexp_full_match(path, '{ps.RUN_PATH_PATTERN}')"""


@register("run_path_parse", RUN_PATH_SQL)
def run_path_parse(spark, d):
    p = run_paths(spark, d)
    return p.filter(ps.is_run_path(F.col("path"))).select("o_orderkey", *ps.run_key(F.col("path")))


LIST_SQL = f"""WITH w AS (SELECT conv_id, turn, {sq.WORDS('text')} AS w FROM conversations)
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_items, md5(array_to_string(w, chr(1))) AS items_md5,
       round(coalesce(list_sum(list_transform(w, lambda t: length(t) / 100.0e0)), 0.0e0), 6) AS prob_sum,
       false AS parse_failed
FROM w"""


@register("list_literal_parse", LIST_SQL)
def list_literal_parse(spark, d):
    c = spread(table(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", words(F.col("text")).alias("w"))
    lit_words = ps.render_list(F.col("w"))
    lit_probs = F.concat(F.lit("["), F.array_join(F.transform("w", lambda t: (F.length(t) / F.lit(100.0))
                                                               .cast("string")), ", "), F.lit("]"))
    parsed = c.select("conv_id", "turn", ps.parse_list_literal(lit_words).alias("items"),
                      ps.parse_list_literal(lit_probs, "double").alias("probs"))
    return rounded(parsed.select(
        "conv_id", "turn", F.size("items").cast("bigint").alias("n_items"),
        F.md5(F.array_join("items", "\u0001")).alias("items_md5"),
        F.aggregate("probs", F.lit(0.0), lambda acc, x: acc + x).alias("prob_sum"),
        (F.col("items").isNull() | F.col("probs").isNull()).alias("parse_failed")), ["prob_sum"])


AGENTS = ["random", "lmkb", "lmkb-random"]
TEMPLATES = ["arrow", "nl", "semicolon"]


def episode_lines(spark, d):
    """Episode log lines 'games:..,agent:..,lm:..,priming_template:..,
    num_priming_examples:..,score:..,steps:..' rendered from events."""
    e = spread(table(spark, d, "events").select("event_id", "user_id", "value", "props"))
    k = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(31))
    line = F.concat(F.lit("games:games/twc/hard/test,agent:"), _pick(AGENTS, F.pmod(F.col("user_id"), F.lit(3))),
                    F.lit(",lm:albert-xxlarge-v2,priming_template:"), _pick(TEMPLATES, F.pmod(F.col("event_id"), F.lit(3))),
                    F.lit(",num_priming_examples:"), k.cast("string"),
                    F.lit(",score:"), (F.col("value") / F.lit(100.0)).cast("string"),
                    F.lit(",steps:"), (F.pmod(F.col("event_id"), F.lit(50)) + 1).cast("double").cast("string"))
    return e.select("event_id", line.alias("line"))


def parse_episode_log(lines):
    m = ps.parse_kv_line(F.col("line"))
    return lines.select("event_id", m["games"].alias("games"), m["agent"].alias("agent"), m["lm"].alias("lm"),
                        m["priming_template"].alias("priming_template"),
                        m["num_priming_examples"].cast("bigint").alias("num_priming_examples"),
                        m["score"].cast("double").alias("score"), m["steps"].cast("double").alias("steps"))


KV_SQL = f"""SELECT event_id, 'games/twc/hard/test' AS games, {_sql_pick(AGENTS, 'user_id % 3')} AS agent,
  'albert-xxlarge-v2' AS lm, {_sql_pick(TEMPLATES, 'event_id % 3')} AS priming_template,
  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 31 AS BIGINT) AS num_priming_examples,
  round(value / 100.0e0, 6) AS score, CAST(event_id % 50 + 1 AS DOUBLE) AS steps
FROM events"""


@register("kv_log_parse", KV_SQL)
def kv_log_parse(spark, d):
    return rounded(parse_episode_log(episode_lines(spark, d)), ["score"])
