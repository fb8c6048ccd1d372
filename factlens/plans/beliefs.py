"""Belief queries over an attempt log derived from ``events``.

scene = user_id; each event is an attempt to put an object (chosen by the
event id) into a container (the event type); the log is ordered by
(ts, event_id); an episode is a scene's day.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from factlens.operators import beliefs as bl
from factlens.plans import sqlparts as sq
from factlens.plans.common import rounded
from factlens.plans.parsing import episode_lines, parse_episode_log, KV_SQL
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


# fixed values (fixture): scene objects by event id, container kinds by event type, object catalogue
OBJECT_NAMES = ["apple", "milk", "towel", "plate", "shoe", "book", "lamp"]
CONTAINER_KIND = {"signup": "c", "error": "c", "purchase": "c", "click": "s", "view": "s"}
CATALOGUE = {
    "apple": {"type": "f", "locations": ["click", "view"]},
    "milk": {"type": "f", "locations": ["purchase"]},
    "towel": {"type": "o", "locations": ["error", "signup"]},
    "plate": {"type": "o", "locations": ["view"]},
    "shoe": {"type": "o", "locations": ["click", "signup", "purchase"]},
    "book": {"type": "o", "locations": ["view", "error"]},
    "cheese": {"type": "f", "locations": ["purchase", "click"]},
    "knife": {"type": "o", "locations": ["error"]},
    "sock": {"type": "o", "locations": ["signup"]},
    "cup": {"type": "o", "locations": ["view", "purchase"]},
    "desk": {"type": "s", "locations": []},
}
CATALOGUE_JSON = json.dumps(CATALOGUE)
PRIMING_N, PRIMING_TEMPLATE, SEED = 10, "arrow", 0
TWC_SCORE = 0.57


def catalogue(spark):
    return bl.read_catalogue(spark, CATALOGUE_JSON)


def attempts(spark, d):
    e = spread(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"))
    obj = F.element_at(F.array(*[F.lit(o) for o in OBJECT_NAMES]),
                       (F.pmod(F.col("event_id"), F.lit(len(OBJECT_NAMES))) + 1).cast("int"))
    return e.select(F.col("user_id").alias("scene"), "event_id", "ts", obj.alias("obj"),
                    F.col("event_type").alias("container"))


def scene_facts(spark, d):
    """One typed fact per attempt: (object, its catalogue type or 'o'),
    (container, its kind)."""
    a = attempts(spark, d)
    types = F.broadcast(catalogue(spark).select(F.col("name").alias("obj"), F.col("type").alias("otype")))
    kind = None
    for k, v in CONTAINER_KIND.items():
        kind = F.when(F.col("container") == k, F.lit(v)) if kind is None else kind.when(F.col("container") == k, F.lit(v))
    arg = lambda n, t: F.struct(n.alias("name"), t.alias("type"))
    facts = F.array(F.struct(F.array(arg(F.col("obj"), F.coalesce("otype", F.lit("o"))),
                                     arg(F.col("container"), kind.otherwise(F.lit("c")))).alias("arguments")))
    return a.join(types, "obj", "left").select("scene", "event_id", facts.alias("facts"))


def _entities(spark, d):
    """Scene entities with their kind, written once per session and input
    (several belief and candidate queries read them)."""
    def build():
        f = scene_facts(spark, d)
        return bl.entities(f, bl.OBJECT_TYPES).withColumn("kind", F.lit("object")).unionByName(
            bl.entities(f, bl.CONTAINER_TYPES).withColumn("kind", F.lit("container")))
    return stored(spark, "scene-entities", [table_path(d, "events")], build)


def _objects(spark, d):
    return _entities(spark, d).filter(F.col("kind") == "object").select("scene", "name", "type")


def _containers(spark, d):
    return _entities(spark, d).filter(F.col("kind") == "container").select("scene", "name", "type")


def _scores(spark, d):
    """Count scorer for the prior: (1 + attempts of obj at container in the
    scene), normalised over the scene's containers."""
    g = bl.grid(_objects(spark, d), _containers(spark, d))
    cnt = attempts(spark, d).groupBy("scene", "obj", "container").agg(F.count(F.lit(1)).alias("n"))
    j = g.join(cnt, ["scene", "obj", "container"], "left").withColumn("_s", F.lit(1.0) + F.coalesce("n", F.lit(0)))
    from pyspark.sql import Window
    return j.withColumn("score", F.col("_s") / F.sum("_s").over(Window.partitionBy("scene", "obj"))) \
            .select("scene", "obj", "container", "score")


# ---------------------------------------------------------------- SQL twins
def _sql_list(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


CAT_CTE = "catalogue(name, type, locations) AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v['type']}', {_sql_list(v['locations']) if v['locations'] else '[]::VARCHAR[]'})"
    for k, v in CATALOGUE.items() if v["type"] in bl.OBJECT_TYPES) + "))"
KIND_SQL = "CASE container " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTAINER_KIND.items()) + " ELSE 'c' END"
ATT_CTE = f"""att AS (
  SELECT user_id AS scene, event_id, ts, {_sql_list(OBJECT_NAMES)}[event_id % {len(OBJECT_NAMES)} + 1] AS obj,
         event_type AS container FROM events
)"""
PRIOR_CTES = [CAT_CTE, ATT_CTE, """objs AS (SELECT DISTINCT scene, obj FROM att)""",
              """conts AS (SELECT DISTINCT scene, container FROM att)""",
              """g AS (SELECT o.scene, o.obj, c.container FROM objs o JOIN conts c ON o.scene = c.scene)""",
              """cnt AS (SELECT scene, obj, container, count(*) AS n FROM att GROUP BY scene, obj, container)""",
              """sc AS (
  SELECT g.scene, g.obj, g.container,
         (1.0e0 + coalesce(cnt.n, 0)) / sum(1.0e0 + coalesce(cnt.n, 0)) OVER (PARTITION BY g.scene, g.obj) AS score
  FROM g LEFT JOIN cnt ON g.scene = cnt.scene AND g.obj = cnt.obj AND g.container = cnt.container
)""", f"""pr AS (
  SELECT *, 1.0e0 / count(*) OVER (PARTITION BY scene, obj) AS p_uniform, score + {bl.PRIOR_FLOOR}e0 AS p FROM sc
)"""]


@register("scene_entities", sq.with_(CAT_CTE, ATT_CTE) + f"""
SELECT DISTINCT a.scene, a.obj AS name, coalesce(c.type, 'o') AS type FROM att a LEFT JOIN catalogue c ON c.name = a.obj
UNION
SELECT DISTINCT scene, container, {KIND_SQL} FROM att""")
def scene_entities(spark, d):
    f = scene_facts(spark, d)
    return bl.entities(f, bl.OBJECT_TYPES).unionByName(bl.entities(f, bl.CONTAINER_TYPES))


@register("belief_prior", sq.with_(*PRIOR_CTES) + """SELECT scene, obj, container, round(p_uniform, 6) AS p_uniform,
  round(p, 6) AS p_scored, round(p / sum(p) OVER (PARTITION BY scene, obj), 6) AS p_norm FROM pr""")
def belief_prior(spark, d):
    s = bl.scored_prior(_scores(spark, d))
    u = bl.uniform_prior(s.select("scene", "obj", "container")).withColumnRenamed("p", "p_uniform")
    out = s.join(u, ["scene", "obj", "container"]).select("scene", "obj", "container", "p_uniform",
                                                         F.col("p").alias("p_scored"), "p_norm")
    return rounded(out, ["p_uniform", "p_scored", "p_norm"])


@register("belief_choice", sq.with_(*PRIOR_CTES, f"""cum AS (
  SELECT *, sum(p) OVER (PARTITION BY scene, obj ORDER BY container ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            / sum(p) OVER (PARTITION BY scene, obj) AS c,
         {sq.HS("'choice'", 'scene', 'obj', str(SEED))} / 4294967296.0e0 AS u
  FROM pr
)""") + """SELECT scene, obj, first(container ORDER BY p DESC, container) AS greedy,
  first(container ORDER BY c) FILTER (WHERE c > u) AS sampled FROM cum GROUP BY scene, obj""")
def belief_choice(spark, d):
    s = bl.scored_prior(_scores(spark, d))
    return bl.greedy_choice(s).join(bl.sampled_choice(s, SEED), ["scene", "obj"], "left")


UPDATE_SQL = sq.with_(*PRIOR_CTES, """outc AS (
  SELECT a.scene, a.obj, a.container, a.ts, a.event_id,
         coalesce(list_contains(c.locations, a.container), true) AS success
  FROM att a LEFT JOIN catalogue c ON c.name = a.obj
)""", """tried AS (SELECT DISTINCT scene, obj, container FROM outc)""", """stored AS (
  SELECT scene, obj, container AS stored_in FROM outc WHERE success
  QUALIFY row_number() OVER (PARTITION BY scene, obj ORDER BY ts DESC, event_id DESC) = 1
)""", """j AS (
  SELECT pr.scene, pr.obj, pr.container, pr.p, t.container IS NOT NULL AS is_tried, s.stored_in
  FROM pr LEFT JOIN tried t ON pr.scene = t.scene AND pr.obj = t.obj AND pr.container = t.container
  LEFT JOIN stored s ON pr.scene = s.scene AND pr.obj = s.obj
)""", """k AS (
  SELECT *, sum(CASE WHEN NOT is_tried THEN p ELSE 0.0e0 END) OVER (PARTITION BY scene, obj) AS remaining,
         bool_or(is_tried) OVER (PARTITION BY scene, obj) AS any_tried FROM j
)""") + """SELECT scene, obj, container,
  round(CASE WHEN stored_in IS NOT NULL THEN CASE WHEN container = stored_in THEN 1.0e0 ELSE 0.0e0 END
             WHEN any_tried THEN CASE WHEN remaining > 0 THEN CASE WHEN NOT is_tried THEN p / remaining ELSE 0.0e0 END END
             ELSE p END, 6) AS p,
  CASE WHEN stored_in IS NOT NULL THEN 'stored' WHEN any_tried THEN 'updated' ELSE 'prior' END AS state
FROM k"""


def belief_update_frame(spark, d):
    prior = bl.scored_prior(_scores(spark, d)).select("scene", "obj", "container", "p")
    outc = bl.attempt_outcomes(attempts(spark, d), catalogue(spark))
    return bl.update(prior, outc, ["ts", "event_id"])


@register("belief_update", UPDATE_SQL)
def belief_update(spark, d):
    return rounded(belief_update_frame(spark, d), ["p"])


def held_items(spark, d):
    a = attempts(spark, d)
    held = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat("obj", F.lit("s"))) \
            .when(F.pmod("event_id", F.lit(3)) == 1, F.expr("substr(obj, 2)")) \
            .otherwise(F.concat(F.upper(F.expr("substr(obj, 1, 1)")), F.expr("substr(obj, 2)")))
    return a.select("scene", F.col("event_id").alias("item_id"), held.alias("held"))


@register("nearest_name", sq.with_(ATT_CTE, """names AS (SELECT DISTINCT scene, obj AS name FROM att)""", """held AS (
  SELECT scene, event_id AS item_id,
         CASE event_id % 3 WHEN 0 THEN obj || 's' WHEN 1 THEN substr(obj, 2)
              ELSE upper(substr(obj, 1, 1)) || substr(obj, 2) END AS held FROM att
)""", """dd AS (
  SELECT h.scene, h.item_id, h.held, n.name AS cand, levenshtein(n.name, h.held) AS dist
  FROM held h JOIN names n ON h.scene = n.scene
)""") + """SELECT scene, item_id, held, first(cand ORDER BY dist, cand) AS nearest, CAST(min(dist) AS BIGINT) AS distance
FROM dd GROUP BY scene, item_id, held""")
def nearest_name(spark, d):
    names = _objects(spark, d)
    out = bl.nearest_name(held_items(spark, d), names)
    return out.withColumn("distance", F.col("distance").cast("bigint"))


ADAPTIVE_CTES = [CAT_CTE, ATT_CTE, """objs AS (SELECT DISTINCT scene, obj FROM att)""",
                 """conts AS (SELECT DISTINCT scene, container FROM att)""", """cand AS (
  SELECT c.scene, k.name AS pobj, c.container FROM conts c
  JOIN (SELECT name, unnest(locations) AS container FROM catalogue) k ON k.container = c.container
  WHERE NOT EXISTS (SELECT 1 FROM objs o WHERE o.scene = c.scene AND o.obj = k.name)
)""", """opts AS (SELECT scene, pobj, list_sort(list(DISTINCT container)) AS opts FROM cand GROUP BY scene, pobj)""",
                 f"""pool AS (
  SELECT scene, pobj, opts[{sq.HS("'loc'", 'scene', 'pobj', str(SEED))} % len(opts) + 1] AS ploc,
         row_number() OVER (PARTITION BY scene ORDER BY pobj) - 1 AS idx FROM opts
)""", """sizes AS (SELECT scene, count(*) AS n FROM pool GROUP BY scene)""", f"""dr AS (
  SELECT o.scene, o.obj, j FROM (SELECT o.scene, o.obj, coalesce(s.n, 0) AS n FROM objs o LEFT JOIN sizes s ON o.scene = s.scene) o,
       LATERAL (SELECT unnest(range(0, least({PRIMING_N}, o.n))) AS j)
)""", f"""dl AS (
  SELECT d.scene, d.obj, d.j, {sq.HS("'perm'", 'd.scene', 'd.obj', 'd.j', str(SEED))} AS perm,
         p.pobj || ' -> ' || p.ploc AS line
  FROM dr d JOIN sizes s ON d.scene = s.scene
  JOIN pool p ON p.scene = d.scene AND p.idx = {sq.HS("'draw'", 'd.scene', 'd.obj', 'd.j', str(SEED))} % s.n
)""", """agg AS (SELECT scene, obj, string_agg(line, chr(10) ORDER BY perm, j) AS body, count(*) AS n FROM dl GROUP BY scene, obj)""",
                 """ap AS (
  SELECT o.scene, o.obj, CAST(coalesce(a.n, 1) AS BIGINT) AS n_examples,
         coalesce(a.body, 'butter -> fridge') || chr(10) || trim(o.obj || ' -> ') AS prompt
  FROM objs o LEFT JOIN agg a ON o.scene = a.scene AND o.obj = a.obj
)"""]


@register("adaptive_priming", sq.with_(*ADAPTIVE_CTES) + "SELECT scene, obj, n_examples, prompt FROM ap")
def adaptive_priming(spark, d):
    tpl = bl.TEMPLATES[PRIMING_TEMPLATE]
    out = bl.adaptive_priming(_objects(spark, d), _containers(spark, d), catalogue(spark), PRIMING_N, tpl, SEED)
    return out.select("scene", F.col("obj"), "n_examples", "prompt")


EPISODE_SQL = sq.with_(CAT_CTE, ATT_CTE, """outc AS (
  SELECT a.*, CAST(a.ts AS DATE) AS day, coalesce(list_contains(c.locations, a.container), true) AS success
  FROM att a LEFT JOIN catalogue c ON c.name = a.obj
)""", """ep AS (
  SELECT scene, day, count(*) AS steps, count(DISTINCT obj) AS max_score,
         count(DISTINCT obj) FILTER (WHERE success) AS score,
         lower(trim(split_part('-= ' || upper(first(container ORDER BY ts, event_id)) || ' =-' || chr(10) || 'You arrive.',
                               chr(10), 1), '=- ')) AS location
  FROM outc GROUP BY scene, day
)""") + """SELECT coalesce(location, 'all') AS location, count(*) AS n_episodes,
  round(avg(CAST(score AS DOUBLE) / max_score), 6) AS mean_score, round(avg(CAST(steps AS DOUBLE)), 6) AS mean_steps
FROM ep GROUP BY GROUPING SETS ((location), ())"""


@register("episode_scores", EPISODE_SQL)
def episode_scores(spark, d):
    outc = bl.attempt_outcomes(attempts(spark, d), catalogue(spark)).withColumn("day", F.to_date("ts"))
    first = F.min_by("container", F.struct("ts", "event_id"))
    ep = outc.groupBy("scene", "day").agg(
        F.count(F.lit(1)).alias("steps"), F.countDistinct("obj").alias("max_score"),
        F.countDistinct(F.when(F.col("success"), F.col("obj"))).alias("score"), first.alias("_first"))
    desc = F.concat(F.lit("-= "), F.upper("_first"), F.lit(" =-\nYou arrive."))
    ep = ep.withColumn("location", bl.location_from_description(desc))
    g = ep.rollup("location").agg(F.count(F.lit(1)).alias("n_episodes"),
                                  F.avg(F.col("score") / F.col("max_score")).alias("mean_score"),
                                  F.avg(F.col("steps").cast("double")).alias("mean_steps"),
                                  F.grouping("location").alias("_g"))
    g = g.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("location")).alias("location"),
                 "n_episodes", "mean_score", "mean_steps")
    return rounded(g, ["mean_score", "mean_steps"])


SERIES_SQL = f"""WITH log AS ({KV_SQL}),
cur AS (SELECT * FROM log WHERE priming_template = 'arrow' AND agent = 'lmkb' AND games LIKE '%hard%'
        AND num_priming_examples <= 20)
SELECT 'lmkb' AS kind, lm, num_priming_examples AS x, round(avg(score), 6) AS mean_score,
       round(stddev_samp(score), 6) AS std_score, count(*) AS n FROM cur GROUP BY lm, num_priming_examples
UNION ALL
SELECT 'uniform prior', NULL, NULL, round(avg(score), 6), round(stddev_pop(score), 6), count(*)
FROM log WHERE agent = 'lmkb-random' AND games LIKE '%hard%'
UNION ALL
SELECT 'TWC', NULL, NULL, {TWC_SCORE}e0, 0.0e0, CAST(0 AS BIGINT)"""


@register("episode_series", SERIES_SQL)
def episode_series(spark, d):
    log = parse_episode_log(episode_lines(spark, d))
    hard = F.col("games").contains("hard")
    cur = log.filter((F.col("priming_template") == "arrow") & (F.col("agent") == "lmkb") & hard
                     & (F.col("num_priming_examples") <= 20))
    series = cur.groupBy("lm", F.col("num_priming_examples").alias("x")).agg(
        F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"), F.count(F.lit(1)).alias("n"))
    series = series.select(F.lit("lmkb").alias("kind"), "lm", "x", "mean_score", "std_score", "n")
    uni = log.filter((F.col("agent") == "lmkb-random") & hard).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count(F.lit(1)).alias("n"))
    uni = uni.select(F.lit("uniform prior").alias("kind"), F.lit(None).cast("string").alias("lm"),
                     F.lit(None).cast("bigint").alias("x"), "mean_score", "std_score", "n")
    twc = spark.createDataFrame([("TWC", None, None, TWC_SCORE, 0.0, 0)],
                                "kind string, lm string, x bigint, mean_score double, std_score double, n bigint")
    return rounded(series.unionByName(uni).unionByName(twc), ["mean_score", "std_score"])
