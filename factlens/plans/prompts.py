"""Prompt construction, N-M solutions, BATS solvability, prompt preparation."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from factlens.functions.hashing import h32
from factlens.functions.text import token_count, words
from factlens.operators import evaluation as ev
from factlens.operators import examples as ex
from factlens.operators import priming as pr
from factlens.operators import prompts as pp
from factlens.operators import scoring as sc
from factlens.plans import fixtures as fx
from factlens.plans import sqlparts as sq
from factlens.plans.common import rounded
from factlens.plans.probe import BASE, FACT_TABLES, MC, METRICS_CTE, REL_METRICS_CTE, Probe
from factlens.sources.tables import spread, table, table_path
from factlens.store import stored

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _priming_sql(k: int, seed: int, fmt: str | None) -> str:
    ctes, last = _priming_parts(k, seed, fmt)
    return sq.with_(*ctes) + last


def _priming_parts(k: int, seed: int, fmt: str | None) -> tuple[list[str], str]:
    """The CTEs of random priming and the final SELECT."""
    if fmt is None:
        line, last = "replace(p.x, '[MASK]', p.y)", "e.x"
    else:
        a, b, c = fmt.split("{}")
        q = lambda s: "'" + s.replace("'", "''") + "'"
        line = f"{q(a)} || p.subj || {q(b)} || p.y || {q(c)}"
        last = f"{q(a)} || e.subj || {q(b)} || '[MASK]' || {q(c)} || chr(10)"
    return [*BASE, sq.EXAMPLES_CTE, f"""pool AS (
  SELECT uuid, rel, subj, y, x, row_number() OVER (PARTITION BY rel ORDER BY subj, uuid) - 1 AS idx,
         count(*) OVER (PARTITION BY rel) AS n FROM examples
)""", """runs AS (SELECT rel, subj, min(idx) AS lo, count(*) AS own FROM pool GROUP BY rel, subj)""",
        f"""slots AS (
  SELECT p.uuid, p.rel, p.y, r.lo, r.own, p.n - r.own AS m, unnest(range(0, least({k}, p.n - r.own))) AS j
  FROM pool p JOIN runs r ON p.rel = r.rel AND p.subj = r.subj
)""", f"""draws AS (
  SELECT uuid, rel, j, u + CASE WHEN u >= lo THEN own ELSE 0 END AS idx
  FROM (SELECT *, {sq.HS('uuid', 'y', str(seed), 'j')} % m AS u FROM slots)
)""", f"""lines AS (SELECT d.uuid, d.j, {line} AS line FROM draws d JOIN pool p ON d.rel = p.rel AND d.idx = p.idx)""",
        """agg AS (SELECT uuid, string_agg(line, chr(10) ORDER BY j) AS body, count(*) AS n_primes FROM lines GROUP BY uuid)"""], f"""
SELECT e.uuid, e.rel, e.subj, e.y, CAST(coalesce(a.n_primes, 0) AS BIGINT) AS n_primes,
       CASE WHEN a.body IS NULL THEN {last} ELSE a.body || chr(10) || {last} END AS x_primed
FROM examples e LEFT JOIN agg a ON e.uuid = a.uuid"""


def _pool(spark, d):
    """Examples and their numbered relation pool (stored once; it depends
    only on the examples, not on k, the seed or the priming format)."""
    e = Probe(spark, d).examples
    ix = stored(spark, "pool-index", [table_path(d, t) for t in FACT_TABLES],
                lambda: pr.index_pool(e.select("uuid", "rel", "subj", "y", "x")))
    return e, ix


@register("priming_random", _priming_sql(3, 0, None))
def priming_random(spark, d):
    e, ix = _pool(spark, d)
    return pr.prime_random(e, k=3, seed=0, priming="nl", index=ix).select(
        "uuid", "rel", "subj", "y", "n_primes", "x_primed")


@register("priming_symbolic", _priming_sql(5, 1, "{} -> {}"))
def priming_symbolic(spark, d):
    e, ix = _pool(spark, d)
    return pr.prime_random(e, k=5, seed=1, priming="{} -> {}", index=ix).select(
        "uuid", "rel", "subj", "y", "n_primes", "x_primed")


PROMPT_WORD = "[^ \\n]+"


def word_count_scorer():
    """A scorer that reads its prompts: each word is a candidate, its logit the
    number of times the prompt has it."""
    word = re.compile(PROMPT_WORD)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(uuid, token, float(n)) for uuid, text in zip(pdf["uuid"], pdf["x_primed"], strict=True)
                for token, n in Counter(word.findall(text)).items()]
        return pd.DataFrame(rows, columns=["uuid", "token", "logit"])
    return score


_PRIMED_CTES, _PRIMED = _priming_parts(3, 0, None)
PRIMED_SQL = sq.with_(*_PRIMED_CTES, f"primed AS ({_PRIMED})", f"""logits AS (
  SELECT uuid, token, CAST(count(*) AS DOUBLE) AS logit
  FROM (SELECT uuid, unnest(regexp_extract_all(x_primed, '{PROMPT_WORD}')) AS token FROM primed) GROUP BY uuid, token
)""", sq.topk_ctes(), METRICS_CTE, REL_METRICS_CTE) + f"SELECT rel, {MC}, n_examples FROM rel_metrics"


@register("primed_metrics", PRIMED_SQL)
def primed_metrics(spark, d):
    """Examples, primed and scored by what stands in their prompts: the whole
    chain from facts to metrics by relation."""
    e, ix = _pool(spark, d)
    primed = pr.prime_random(e, k=3, seed=0, priming="nl", index=ix)
    preds = sc.lowered(sc.topk_arrays(sc.score_prompts(primed, word_count_scorer), Probe(spark, d).vocab)).drop("logits")
    m = ev.example_metrics(e.join(preds, "uuid", "left").withColumn("targets", F.array("y")))
    return rounded(ev.relation_metrics(m), ev.METRIC_COLS)


OTHER_SQL = sq.with_(*BASE, sq.EXAMPLES_CTE, """sols AS (
  SELECT rel, subj, list(DISTINCT obj) AS sols FROM raw_facts
  WHERE rel IN (SELECT rel FROM relations WHERE type = 'N-M') GROUP BY rel, subj
)""", """o AS (
  SELECT e.uuid, e.rel, e.subj, e.y,
         list_sort(list_filter(coalesce(s.sols, []::VARCHAR[]), lambda v: v <> e.y)) AS other
  FROM examples e LEFT JOIN sols s ON e.rel = s.rel AND e.subj = s.subj
)""") + "SELECT uuid, rel, subj, y, array_to_string(other, '|') AS other_solutions, CAST(len(other) AS BIGINT) AS n_other FROM o"


@register("other_solutions", OTHER_SQL)
def other_solutions(spark, d):
    p = Probe(spark, d)
    o = ex.other_solutions(p.facts, p.examples, p.relations)
    return o.select("uuid", "rel", "subj", "y", F.array_join("other_solutions", "|").alias("other_solutions"),
                    F.size("other_solutions").cast("bigint").alias("n_other"))


BATS_RAW_CTE = """bats_raw AS (
  SELECT CASE n_regionkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'D' WHEN 2 THEN 'L' ELSE 'E' END
           || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS rel,
         s_name AS subj,
         list_sort(list(DISTINCT CASE WHEN l_partkey % 2 = 0 THEN p_brand ELSE lower(p_brand) END)) AS answers
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2
)"""
BATS_CTE = BATS_RAW_CTE + """,
allowed AS (SELECT token FROM vocab UNION SELECT lower(token) FROM vocab),
bats_ans AS (SELECT rel, subj, unnest(answers) AS a, unnest(range(1, len(answers) + 1)) AS pos FROM bats_raw),
bats_kept AS (
  SELECT b.rel, b.subj, list(b.a ORDER BY b.pos) FILTER (WHERE al.token IS NOT NULL) AS kept
  FROM bats_ans b LEFT JOIN allowed al ON b.a = al.token GROUP BY b.rel, b.subj
),
bats AS (
  SELECT r.rel, r.subj, r.subj AS x, r.rel || '_' || r.subj AS uuid, r.answers,
         coalesce(k.kept, []::VARCHAR[]) AS y, len(coalesce(k.kept, []::VARCHAR[])) > 0 AS solvable
  FROM bats_raw r JOIN bats_kept k ON r.rel = k.rel AND r.subj = k.subj
)"""

SOLVABLE_SQL = sq.with_(sq.RELATIONS_CTE, sq.RAW_FACTS_CTE, sq.VOCAB_CTE, BATS_CTE, """per_rel AS (
  SELECT rel, count(*) AS n_examples, sum(CASE WHEN solvable THEN 1 ELSE 0 END) AS n_solvable FROM bats GROUP BY rel
)""") + """SELECT rel, CAST(n_examples AS BIGINT) AS n_examples, CAST(n_solvable AS BIGINT) AS n_solvable,
       n_solvable > 0 AS kept FROM per_rel
UNION ALL
SELECT 'total', CAST(coalesce(sum(n_examples) FILTER (WHERE n_solvable > 0), 0) AS BIGINT),
       CAST(coalesce(sum(n_solvable), 0) AS BIGINT), true FROM per_rel"""


@register("bats_solvable", SOLVABLE_SQL)
def bats_solvable(spark, d):
    per = Probe(spark, d).bats.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.count_if("solvable").alias("s"))
    # the categories' rows and their total by one pass over them
    out = per.groupingSets([["rel"], []], "rel").agg(
        F.grouping("rel").alias("total"), F.sum("n").alias("n"), F.sum(F.when(F.col("s") > 0, F.col("n"))).alias("kept_n"), F.sum("s").alias("s"))
    whole = F.col("total") == 1
    return out.select(F.when(whole, "total").otherwise(F.col("rel")).alias("rel"),
                      F.coalesce(F.when(whole, F.col("kept_n")).otherwise(F.col("n")), F.lit(0)).alias("n_examples"),
                      F.coalesce("s", F.lit(0)).alias("n_solvable"), (whole | (F.col("s") > 0)).alias("kept"))


BATS_K, BATS_SEED, BATS_FORMAT = 5, 2, "({}; {})"
PRIMING_BATS_SQL = sq.with_(sq.RELATIONS_CTE, sq.RAW_FACTS_CTE, sq.VOCAB_CTE, BATS_CTE, """more AS (
  SELECT 'S' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS rel, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS subj,
         CASE WHEN p_brand IN (SELECT token FROM allowed) THEN [p_brand] ELSE []::VARCHAR[] END AS y FROM part
)""", """every AS (
  SELECT uuid, rel, subj, y FROM bats UNION ALL SELECT rel || '_' || subj, rel, subj, y FROM more
)""", """e AS (
  SELECT *, len(y) > 0 AS solvable FROM every WHERE rel IN (SELECT rel FROM every WHERE len(y) > 0)
)""", """pool AS (
  SELECT uuid, rel, subj, y, row_number() OVER (PARTITION BY rel ORDER BY subj, uuid) - 1 AS idx,
         count(*) OVER (PARTITION BY rel) AS n FROM e WHERE solvable
)""", """runs AS (SELECT rel, subj, min(idx) AS lo, count(*) AS own FROM pool GROUP BY rel, subj)""",
    f"""slots AS (
  SELECT uuid, rel, lo, own, n - own AS m, unnest(range(0, least({BATS_K}, n - own))) AS j
  FROM (SELECT e.uuid, e.rel, coalesce(r.lo, 0) AS lo, coalesce(r.own, 0) AS own, s.n
        FROM e JOIN (SELECT DISTINCT rel, n FROM pool) s ON e.rel = s.rel
        LEFT JOIN runs r ON e.rel = r.rel AND e.subj = r.subj)
)""", f"""draws AS (
  SELECT uuid, rel, j, u + CASE WHEN u >= lo THEN own ELSE 0 END AS idx
  FROM (SELECT *, {sq.HS('uuid', str(BATS_SEED), 'j')} % m AS u FROM slots)
)""", f"""lines AS (
  SELECT d.uuid, d.j, '(' || p.subj || '; ' || p.y[{sq.HS('d.uuid', 'd.j', str(BATS_SEED))} % len(p.y) + 1] || ')' AS line
  FROM draws d JOIN pool p ON d.rel = p.rel AND d.idx = p.idx
)""", """agg AS (SELECT uuid, string_agg(line, chr(10) ORDER BY j) AS body, count(*) AS n_primes FROM lines GROUP BY uuid)""") + """
SELECT e.uuid, e.rel, e.solvable, CAST(coalesce(a.n_primes, 0) AS BIGINT) AS n_primes,
       coalesce(a.body || chr(10), '') || '(' || e.subj || '; [MASK])' || chr(10) AS x_primed
FROM e LEFT JOIN agg a ON e.uuid = a.uuid"""


@register("priming_bats", PRIMING_BATS_SQL)
def priming_bats(spark, d):
    """Multi-answer rows of every category with a solvable row are primed; only
    solvable rows are drawn, each line with one of its answers."""
    def build():
        v = Probe(spark, d).vocab
        b = Probe(spark, d).bats.select("uuid", "rel", "subj", "y", "solvable")
        b = b.unionByName(fx.part_examples(spark, d, v))
        return ex.solvable_relations(b).withColumn("x", F.col("subj"))
    e = stored(spark, "bats-priming", [table_path(d, t) for t in FACT_TABLES], build)
    return pr.prime_random(e, BATS_K, BATS_SEED, BATS_FORMAT, pool=e.filter("solvable")).select(
        "uuid", "rel", "solvable", "n_primes", "x_primed")


CASE_SQL = """WITH g AS (
  SELECT c_custkey, c_name AS subj, n_name,
         '/people/person/' || CASE c_custkey % 3 WHEN 0 THEN 'place_of_birth' WHEN 1 THEN 'date_of_birth'
                                   ELSE 'place_of_death' END AS pred
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), h AS (SELECT *, string_split(pred, '/')[-1] AS rel FROM g)
SELECT 'gre_' || CAST(c_custkey AS VARCHAR) AS uuid, rel, replace(rel, '_', '-') AS label, subj,
       CASE WHEN rel = 'date_of_birth' THEN CAST(1900 + c_custkey % 100 AS VARCHAR) ELSE n_name END AS y,
       CASE rel WHEN 'place_of_birth' THEN subj || ' was born in [MASK].'
                WHEN 'date_of_birth' THEN subj || ' (born [MASK]).'
                WHEN 'place_of_death' THEN subj || ' died in [MASK].' END AS x
FROM h"""


@register("template_case", CASE_SQL)
def template_case(spark, d):
    g = fx.gre_facts(spark, d)
    return g.select("uuid", F.element_at(F.split("pred", "/"), -1).alias("rel"),
                    pp.relation_label(F.col("pred")).alias("label"), "subj", F.col("obj").alias("y"),
                    pp.sentence_by_suffix(F.col("pred"), F.col("subj"), fx.GRE_TEMPLATES).alias("x"))


MASK_TOKEN = "<mask>"
PREPARE_SQL = f"""WITH d AS (SELECT doc_id, {sq.WORDS('text')} AS w FROM documents),
m AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN {sq.H("'doc|' || CAST(doc_id AS VARCHAR)")} % len(w) END AS u FROM d),
p AS (SELECT doc_id, len(w) AS n,
        array_to_string(list_transform(w, lambda t, i: CASE WHEN i - 1 = u THEN '[MASK]' ELSE t END), ' ') AS x FROM m),
q AS (SELECT doc_id, n, {sq.WORDS(f"replace(x, '[MASK]', '{MASK_TOKEN}')")} AS toks, trim(split_part(x, '[MASK]', 1)) AS prefix FROM p),
r AS (SELECT doc_id, n, list_slice(toks, greatest(len(toks) - 499, 1), len(toks)) AS kept, prefix FROM q)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(len(kept) AS BIGINT) AS n_kept,
       CAST(list_position(kept, '{MASK_TOKEN}') AS BIGINT) AS mask_pos,
       md5(array_to_string(kept, ' ')) AS prepared_md5, md5(prefix) AS prefix_md5,
       CAST({sq.TOKENS('prefix')} AS BIGINT) AS prefix_tokens
FROM r"""


@register("prompt_prepare", PREPARE_SQL)
def prompt_prepare(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", words(F.col("text")).alias("w"))
    n = F.size("w")
    u = F.when(n > 0, F.pmod(h32(F.concat(F.lit("doc|"), F.col("doc_id").cast("string"))), n))
    x = F.array_join(F.transform("w", lambda t, i: F.when(i == u, F.lit(pp.MASK)).otherwise(t)), " ")
    t = docs.select("doc_id", n.alias("n"), x.alias("x"))
    t = t.withColumn("kept", pp.keep_last_tokens(words(F.replace(F.col("x"), F.lit(pp.MASK), F.lit(MASK_TOKEN)))))
    t = t.withColumn("prefix", pp.for_left_to_right_model(F.col("x")))
    return t.select("doc_id", F.col("n").cast("bigint").alias("n_tokens"),
                    F.size("kept").cast("bigint").alias("n_kept"),
                    pp.first_position(F.col("kept"), MASK_TOKEN).cast("bigint").alias("mask_pos"),
                    F.md5(F.array_join("kept", " ")).alias("prepared_md5"), F.md5("prefix").alias("prefix_md5"),
                    token_count(F.col("prefix")).cast("bigint").alias("prefix_tokens"))


LENGTH_SQL = f"""SELECT 'documents' AS source, count(*) AS n_rows, round(avg({sq.TOKENS('text')}), 6) AS mean_tokens FROM documents
UNION ALL
SELECT 'conversations', count(*), round(avg(t), 6) FROM (SELECT conv_id, sum({sq.TOKENS('text')}) AS t FROM conversations GROUP BY conv_id)
UNION ALL
SELECT 'benchmark', count(*), round(avg({sq.TOKENS('text')}), 6) FROM benchmark"""


@register("prompt_length", LENGTH_SQL)
def prompt_length(spark, d):
    def mean(df, src):
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("t").alias("mean_tokens")) \
                 .select(F.lit(src).alias("source"), "n_rows", "mean_tokens")
    docs = spread(table(spark, d, "documents").select("text")).select(token_count(F.col("text")).alias("t"))
    # a conversation's prompt is its turns joined by newlines: its token count is the sum over turns
    conv = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(token_count(F.col("text"))).alias("t"))
    bench = table(spark, d, "benchmark").select(token_count(F.col("text")).alias("t"))
    out = mean(docs, "documents").unionByName(mean(conv, "conversations")).unionByName(mean(bench, "benchmark"))
    return rounded(out, ["mean_tokens"])


LONG_SQL = f"""WITH v AS (SELECT DISTINCT source AS token FROM documents WHERE {sq.H('source')} % 5 <> 0)
SELECT doc_id AS uuid, lang AS rel, source AS y, {sq.TOKENS('text')} AS n_tokens FROM documents
WHERE coalesce(length(source), 0) > 0 AND coalesce(length(lang), 0) > 0 AND {sq.TOKENS('text')} <= 100 AND source IN (SELECT token FROM v)"""


@register("long_prompt_filter", LONG_SQL)
def long_prompt_filter(spark, d):
    """The validity rule on prompts of any length: documents as prompts, their
    sources as answers, some of them out of vocabulary."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))
    rows = docs.select(F.col("doc_id").alias("uuid"), F.col("lang").alias("rel"), F.col("lang").alias("subj"),
                       F.col("source").alias("y"), F.col("text").alias("x"))
    vocab = fx.vocab(spark, d, rows.select(F.col("y").alias("obj")))
    return ex.valid_examples(rows, vocab).select("uuid", "rel", "y", token_count(F.col("x")).cast("bigint").alias("n_tokens"))
