"""Command filtering, text cleanup and candidate continuation scoring on the
conversations, pages, benchmark and events tables."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from factlens.functions.hashing import TWO_POW_32, h32
from factlens.functions.text import WS_CLASS, words
from factlens.operators import beliefs as bl
from factlens.operators import commands as cm
from factlens.operators import continuations as ct
from factlens.operators import textops as tx
from factlens.plans import sqlparts as sq
from factlens.plans.common import rounded
from factlens.session import bounded_broadcast
from factlens.sources.tables import spread, table

QUERIES, ORACLE = {}, {}
CAP_K, SEED = 10, 0
MAX_CANDIDATES = 100_000


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def commands_of(w):
    """Admissible commands built from a turn's words: verb by position."""
    def cmd(x, i):
        nxt = F.get(w, i + 1)
        r = F.pmod(i, F.lit(9))
        return (F.when(r == 0, F.when(F.pmod(i, F.lit(36)) == 0, F.lit("examine cookbook"))
                       .otherwise(F.concat(F.lit("examine "), x)))
                 .when(r == 1, F.concat(F.lit("take "), x, F.lit(" from "), F.coalesce(nxt, F.lit("floor"))))
                 .when(r == 2, F.concat(F.lit("open "), x))
                 .when(r == 3, F.concat(F.lit("close "), x))
                 .when(r == 4, F.concat(F.lit("drop "), x))
                 .when(r == 5, F.concat(F.lit("go "), x))
                 .when(r == 6, F.lit("look"))
                 .when(r == 7, F.lit("inventory"))
                 .otherwise(F.concat(F.lit("put "), x, F.lit(" in "), F.coalesce(nxt, F.lit("box")))))
    return F.transform(w, cmd)


CMD_SQL_EXPR = """list_transform(w, lambda x, i: CASE (i - 1) % 9
    WHEN 0 THEN CASE WHEN (i - 1) % 36 = 0 THEN 'examine cookbook' ELSE 'examine ' || x END
    WHEN 1 THEN 'take ' || x || ' from ' || coalesce(w[i + 1], 'floor')
    WHEN 2 THEN 'open ' || x WHEN 3 THEN 'close ' || x WHEN 4 THEN 'drop ' || x WHEN 5 THEN 'go ' || x
    WHEN 6 THEN 'look' WHEN 7 THEN 'inventory'
    ELSE 'put ' || x || ' in ' || coalesce(w[i + 1], 'box') END)"""

COMMAND_SQL = f"""WITH t AS (SELECT conv_id, turn, {sq.WORDS('text')} AS w FROM conversations),
c AS (SELECT conv_id, turn, w, {CMD_SQL_EXPR} AS cmds FROM t),
f AS (
  SELECT c.conv_id, c.turn, c.w, c.cmds, coalesce(p.w, []::VARCHAR[]) AS stored,
         list_filter(c.cmds, lambda x: (NOT contains(x, 'examine') OR contains(x, 'cookbook'))
             AND x NOT IN ('look', 'inventory') AND NOT starts_with(x, 'close') AND NOT starts_with(x, 'drop')
             AND NOT starts_with(x, 'open')) AS filtered
  FROM c LEFT JOIN t p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
),
g AS (
  SELECT *,
    CASE WHEN len(filtered) > {CAP_K} THEN list_transform(list_slice(list_sort(list_transform(filtered, lambda x, j:
        {{'h': {sq.HS(str(SEED), 'conv_id', 'turn', 'j - 1')}, 'j': j - 1, 'c': x}})), 1, {CAP_K}), lambda s: s.c)
      ELSE filtered END AS capped,
    list_filter(filtered, lambda x: starts_with(x, 'take')
      AND NOT coalesce(list_bool_or(list_transform(stored, lambda o: contains(split_part(x, 'from', 1), o))), false)) AS takes,
    list_filter(filtered, lambda x: contains(x, w[-1]))[1] AS container_cmd
  FROM f
),
h AS (
  SELECT *, CASE WHEN len(takes) > 0 THEN takes[{sq.HS(str(SEED), 'conv_id', 'turn')} % len(takes) + 1] END AS choice
  FROM g
)
SELECT conv_id, turn, CAST(len(cmds) AS BIGINT) AS n_cmds, CAST(len(filtered) AS BIGINT) AS n_filtered,
       md5(array_to_string(filtered, chr(10))) AS filtered_md5, CAST(len(capped) AS BIGINT) AS n_capped,
       md5(array_to_string(capped, chr(10))) AS capped_md5, CAST(len(takes) AS BIGINT) AS n_take,
       choice AS take_choice, container_cmd, CAST(list_position(filtered, choice) - 1 AS BIGINT) AS chosen_idx
FROM h"""


@register("command_filter", COMMAND_SQL)
def command_filter(spark, d):
    t = spread(table(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", words(F.col("text")).alias("w"))
    prev = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("stored"))
    c = t.join(prev, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "w", commands_of(F.col("w")).alias("cmds"),
        F.coalesce("stored", F.array().cast("array<string>")).alias("stored"))
    c = c.withColumn("filtered", cm.useful_commands(F.col("cmds")))
    c = c.withColumn("capped", cm.cap_commands(F.col("filtered"), CAP_K, SEED, F.col("conv_id"), F.col("turn")))
    c = c.withColumn("takes", cm.take_choices(F.col("filtered"), F.col("stored")))
    c = c.withColumn("container_cmd", cm.first_mentioning(F.col("filtered"), F.get("w", F.size("w") - 1)))
    c = c.withColumn("choice", cm.uniform_pick(F.col("takes"), SEED, F.col("conv_id"), F.col("turn")))
    pos = F.array_position("filtered", F.col("choice"))
    return c.select("conv_id", "turn", F.size("cmds").cast("bigint").alias("n_cmds"),
                    F.size("filtered").cast("bigint").alias("n_filtered"),
                    F.md5(F.array_join("filtered", "\n")).alias("filtered_md5"),
                    F.size("capped").cast("bigint").alias("n_capped"),
                    F.md5(F.array_join("capped", "\n")).alias("capped_md5"),
                    F.size("takes").cast("bigint").alias("n_take"), F.col("choice").alias("take_choice"),
                    "container_cmd", F.when(F.col("choice").isNotNull(), pos - 1).cast("bigint").alias("chosen_idx"))


def STRIP(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g')"


def game_text():
    """A turn as game text: by its number plain, an observation behind the
    welcome banner, or an inventory (empty or with an item for each clause)."""
    said, kind = F.col("text"), F.pmod(F.col("turn"), F.lit(4))
    items = F.concat(F.lit(tx.CARRYING + "\n  a "), F.replace(said, F.lit(", "), F.lit("\n  some ")))
    return (F.when(kind == 1, F.concat(said, F.lit("\n" + tx.WELCOME + "\n"), said, F.lit("  ")))
             .when((kind == 2) & (F.pmod(F.col("conv_id"), F.lit(5)) == 0), F.lit(tx.NOTHING))
             .when(kind == 2, items).otherwise(said))


GAME_TEXT_SQL = f"""CASE WHEN turn % 4 = 1 THEN text || chr(10) || '{tx.WELCOME}' || chr(10) || text || '  '
    WHEN turn % 4 = 2 AND conv_id % 5 = 0 THEN '{tx.NOTHING}'
    WHEN turn % 4 = 2 THEN '{tx.CARRYING}' || chr(10) || '  a ' || replace(text, ', ', chr(10) || '  some ')
    ELSE text END"""
TEXT_SQL = f"""WITH s AS (SELECT conv_id, turn, {GAME_TEXT_SQL} AS text FROM conversations),
t AS (SELECT *, split_part(text, chr(10), 1) AS descr FROM s),
o AS (
  SELECT *, CASE WHEN position(descr IN text) > 0 THEN replace(text, descr, '') ELSE text END AS o1 FROM t
),
p AS (
  SELECT *, CASE WHEN position('{tx.WELCOME}' IN o1) > 0 THEN {STRIP(f"split_part(o1, '{tx.WELCOME}', 2)")}
               ELSE o1 END AS obs,
         CASE WHEN text = '{tx.NOTHING}' THEN []::VARCHAR[] ELSE
           list_transform(list_filter(list_transform(string_split(replace(text, '{tx.CARRYING}', ''), chr(10) || ' '),
               lambda s: {STRIP('s')}), lambda s: length(s) > 0),
             lambda s: array_to_string(list_filter({sq.WORDS('s')}, lambda x: x NOT IN ({", ".join(f"'{a}'" for a in tx.ARTICLES)})), ' '))
         END AS items
  FROM o
)
SELECT conv_id, turn, CAST(length(obs) AS BIGINT) AS obs_len, md5(obs) AS obs_md5,
       CAST(len(items) AS BIGINT) AS n_items, md5(array_to_string(items, chr(1))) AS items_md5,
       lower(trim(descr, '=- ')) AS location
FROM p"""


@register("text_cleanup", TEXT_SQL)
def text_cleanup(spark, d):
    t = spread(table(spark, d, "conversations").select("conv_id", "turn", "text")) \
        .select("conv_id", "turn", game_text().alias("text"))
    descr = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    obs = tx.clean_observation(F.col("text"), descr)
    items = tx.inventory_items(F.col("text"))
    return t.select("conv_id", "turn", F.length(obs).cast("bigint").alias("obs_len"), F.md5(obs).alias("obs_md5"),
                    F.size(items).cast("bigint").alias("n_items"),
                    F.md5(F.array_join(items, "\u0001")).alias("items_md5"),
                    bl.location_from_description(F.col("text")).alias("location"))


TITLE = "<title>(.*?)</title>"
PAGE_SQL = f"""WITH p AS (SELECT page_id, html, regexp_extract(html, '{TITLE}', 1) AS descr FROM pages),
o AS (SELECT *, CASE WHEN length(descr) > 0 AND position(descr IN html) > 0 THEN replace(html, descr, '') ELSE html END AS obs FROM p)
SELECT page_id, CAST(length(obs) AS BIGINT) AS obs_len, md5(obs) AS obs_md5, lower(trim(descr, '=- ')) AS location FROM o"""


@register("page_cleanup", PAGE_SQL)
def page_cleanup(spark, d):
    p = spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", "html", F.regexp_extract("html", TITLE, 1).alias("descr"))
    obs = F.when(F.length("descr") > 0, tx.clean_observation(F.col("html"), F.col("descr"))).otherwise(F.col("html"))
    return p.select("page_id", F.length(obs).cast("bigint").alias("obs_len"), F.md5(obs).alias("obs_md5"),
                    F.lower(F.btrim("descr", F.lit("=- "))).alias("location"))


MASK = "<mask>"
SUBWORD = "(.{1,4})"   # fixture subword rule: chunks of up to four characters
LOGIT_SCALE = 4.0


def candidate_prompts_frame(spark, d):
    """Per (scene, obj, container, subword position): the object's priming
    prompt, the container's previous subwords, the mask and its remaining
    subwords, blanks dropped, space-joined, newline-terminated.  Candidates
    are the scene's own containers (an equi-join with bounded fan-out)."""
    from factlens.plans import beliefs as pb
    ap = pb.adaptive_priming(spark, d).select("scene", "obj", F.col("prompt").alias("sentence"))
    conts = pb._containers(spark, d).select("scene", F.col("name").alias("candidate"))
    j = ap.join(conts, "scene").withColumn("sub", F.regexp_extract_all("candidate", F.lit(SUBWORD), 1))
    j = j.select("scene", "obj", "sentence", "candidate", "sub", F.posexplode("sub").alias("pos", "token"))
    prev = F.slice("sub", 1, F.col("pos"))
    nxt = F.array_join(F.slice("sub", F.col("pos") + 2, F.size("sub")), "")
    parts = F.filter(F.array(F.col("sentence"), F.array_join(prev, ""), F.lit(MASK), nxt), lambda s: F.length(s) > 0)
    return j.select("scene", "obj", "candidate", F.col("pos").cast("bigint").alias("pos"), "token",
                    F.array_join(prev, " ").alias("identifier"),
                    F.concat(F.array_join(parts, " "), F.lit("\n")).alias("prompt"))


def _sql_prompts():
    from factlens.plans import beliefs as pb
    return [*pb.ADAPTIVE_CTES, f"""cp0 AS (
  SELECT a.scene, a.obj, a.prompt AS sentence, c.container AS candidate,
         regexp_extract_all(c.container, '{SUBWORD}', 1) AS sub
  FROM ap a JOIN conts c ON a.scene = c.scene
)""", """cp1 AS (SELECT *, unnest(range(0, len(sub))) AS pos FROM cp0)""", f"""cp AS (
  SELECT scene, obj, candidate, pos, sub[pos + 1] AS token,
         array_to_string(sub[1:pos], ' ') AS identifier,
         array_to_string(list_filter([sentence, array_to_string(sub[1:pos], ''), '{MASK}',
                                      array_to_string(sub[pos + 2:len(sub)], '')], lambda s: length(s) > 0), ' ')
           || chr(10) AS prompt
  FROM cp1
)"""]


@register("candidate_prompts", sq.with_(*_sql_prompts()) + """SELECT scene, obj, candidate, CAST(pos AS BIGINT) AS pos,
  token, identifier, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_len FROM cp""")
def candidate_prompts(spark, d):
    c = candidate_prompts_frame(spark, d)
    return c.select("scene", "obj", "candidate", "pos", "token", "identifier", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("bigint").alias("prompt_len"))


def candidate_probs_frame(spark, d):
    """Continuation probability of each candidate: each subword is scored at
    the mask of its prompt, a candidate takes its best subword, and
    candidates are normalised per object.  The fixture scorer's vocabulary
    is the scene's candidate subwords; logit = 4 * hash(md5(prompt), token)
    / 2^32, bounded in [0, 4), so the softmax is one grouped aggregate
    (sum of exp) with no max shift.  One pass over the prompts: the prompt
    hash is computed once per prompt, the vocabulary comes from the scene's
    containers."""
    from factlens.plans import beliefs as pb
    cp = candidate_prompts_frame(spark, d).withColumn("_pm", F.md5("prompt")).drop("prompt")
    conts = pb._containers(spark, d).select("scene", F.col("name").alias("candidate"))
    vocab = conts.select("scene", F.explode(F.regexp_extract_all("candidate", F.lit(SUBWORD), 1)).alias("v")) \
        .distinct()
    lg = cp.join(vocab, "scene").withColumn(
        "_e", F.exp(F.lit(LOGIT_SCALE) * h32(F.col("_pm"), F.col("v")) / F.lit(TWO_POW_32)))
    per = lg.groupBy("scene", "obj", "candidate", "pos").agg(
        (F.max(F.when(F.col("v") == F.col("token"), F.col("_e"))) / F.sum("_e")).alias("p"))
    best = per.groupBy("scene", "obj", "candidate").agg(F.max("p").alias("best"))
    return best.withColumn("prob", F.col("best") / F.sum("best").over(Window.partitionBy("scene", "obj"))) \
               .select("scene", "obj", "candidate", "prob")


@register("candidate_probs", sq.with_(*_sql_prompts(), """pr AS (SELECT DISTINCT scene, obj, prompt FROM cp)""",
                                      """vo AS (SELECT DISTINCT scene, token FROM cp)""", f"""lg AS (
  SELECT pr.scene, pr.obj, pr.prompt, vo.token,
         {LOGIT_SCALE}e0 * {sq.HS('md5(pr.prompt)', 'vo.token')} / 4294967296.0e0 AS logit
  FROM pr JOIN vo ON pr.scene = vo.scene
)""", """lg2 AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY scene, obj, prompt)) AS e FROM lg)""",
                                      """lg3 AS (SELECT *, e / sum(e) OVER (PARTITION BY scene, obj, prompt) AS p FROM lg2)""",
                                      """best AS (
  SELECT cp.scene, cp.obj, cp.candidate, max(lg3.p) AS best FROM cp
  JOIN lg3 ON cp.scene = lg3.scene AND cp.obj = lg3.obj AND cp.prompt = lg3.prompt AND cp.token = lg3.token
  GROUP BY cp.scene, cp.obj, cp.candidate
)""") + "SELECT scene, obj, candidate, round(best / sum(best) OVER (PARTITION BY scene, obj), 6) AS prob FROM best")
def candidate_probs(spark, d):
    return rounded(candidate_probs_frame(spark, d), ["prob"])


CHUNK = re.compile(".{1,4}")


def chunk_count_scorer():
    """A scorer that reads its prompts: their words' subwords, by how often the
    prompt has them."""
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(key, token, float(n)) for key, text in zip(pdf["text_key"], pdf["prompt"], strict=True)
                for token, n in Counter(t for w in re.findall("[^ \\n]+", text) for t in CHUNK.findall(w)).items()]
        return pd.DataFrame(rows, columns=["text_key", "token", "logit"])
    return score


def trie_inputs(spark, d):
    """Primed sentences (scene, obj, sentence) and candidates (scene, candidate, sub)."""
    from factlens.plans import beliefs as pb
    sentences = pb.adaptive_priming(spark, d).select("scene", "obj", F.col("prompt").alias("sentence"))
    conts = pb._containers(spark, d).select("scene", F.col("name").alias("candidate")).distinct()
    return sentences, conts.withColumn("sub", F.regexp_extract_all("candidate", F.lit(SUBWORD), 1))


@register("candidate_trie_probs", sq.with_(*_sql_prompts(), """cand_sub AS (SELECT DISTINCT scene, candidate, sub FROM cp0)""",
                                           """edge AS (
  SELECT scene, candidate, sub[1:pos] AS prefix, sub[pos + 1] AS token, array_to_string(sub[pos + 2:len(sub)], '') AS rest
  FROM (SELECT *, unnest(range(0, len(sub))) AS pos FROM cand_sub)
)""", """node AS (SELECT scene, prefix, arg_min(rest, candidate) AS rest FROM edge GROUP BY scene, prefix)""", f"""npr AS (
  SELECT a.scene, a.obj, n.prefix, array_to_string(list_filter([a.prompt, array_to_string(n.prefix, ''), '{MASK}', n.rest],
         lambda s: length(s) > 0), ' ') || chr(10) AS prompt
  FROM ap a JOIN node n ON a.scene = n.scene
)""", """cnt AS (
  SELECT prompt, token, CAST(count(*) AS DOUBLE) AS logit FROM (
    SELECT prompt, unnest(regexp_extract_all(w, '.{1,4}')) AS token FROM (
      SELECT prompt, unnest(regexp_extract_all(prompt, '[^ \\n]+')) AS w FROM (SELECT DISTINCT prompt FROM npr)))
  GROUP BY prompt, token
)""", """soft AS (SELECT prompt, token, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS p
  FROM cnt WINDOW w AS (PARTITION BY prompt))""", """tb AS (
  SELECT npr.scene, npr.obj, e.candidate, coalesce(max(soft.p), 0) AS best FROM npr JOIN edge e ON e.scene = npr.scene AND e.prefix = npr.prefix
  LEFT JOIN soft ON soft.prompt = npr.prompt AND soft.token = e.token GROUP BY npr.scene, npr.obj, e.candidate
)""") + """SELECT scene, obj, candidate, round(CASE WHEN sum(best) OVER w > 0 THEN best / sum(best) OVER w END, 6) AS prob
FROM tb WINDOW w AS (PARTITION BY scene, obj)""")
def candidate_trie_probs(spark, d):
    return rounded(ct.continuation_probs(*trie_inputs(spark, d), chunk_count_scorer, MASK), ["prob"])
