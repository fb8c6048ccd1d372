"""Neighbour search over the embeddings table, close pools and close priming."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.functions.hashing import h32
from factlens.operators import neighbours as nb
from factlens.operators import priming as pr
from factlens.plans.common import rounded
from factlens.sources.tables import table, table_path
from factlens.store import stored

QUERIES, ORACLE = {}, {}
TOPK, POOL, PRIME_K, PRIME_SEED = 301, 20, 3, 2


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _topk(spark, d):
    """The neighbour index, computed once per embeddings input and kept in the
    store (the reference's neighbour cache, keyed by input and code)."""
    return stored(spark, f"neighbours-top{TOPK}", [table_path(d, "embeddings")],
                  lambda: nb.projection_topk(_vectors(spark, d), k=TOPK))


def _members(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("rel"),
                                                F.col("vec_id").alias("id"))


TOPK_CTE = f"""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nv AS (SELECT id, e, list_dot_product(e, e) AS nn FROM v),
sims AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.e, b.e) / b.nn AS sim FROM v a, nv b),
topk AS (
  SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j ASC) AS rank
  FROM sims QUALIFY rank <= {TOPK}
)"""
CLOSE_CTE = f"""m AS (SELECT vec_id AS id, 'g' || CAST(label AS VARCHAR) AS rel FROM embeddings),
pairs AS (
  SELECT a.rel, a.id AS subj, b.id AS cand,
         CASE WHEN a.id = b.id THEN 1000 ELSE coalesce(t.rank - 1, 400) END AS key
  FROM m a JOIN m b ON a.rel = b.rel LEFT JOIN topk t ON t.i = a.id AND t.j = b.id
),
close AS (
  SELECT rel, subj, cand, row_number() OVER (PARTITION BY rel, subj ORDER BY key, cand) AS pos
  FROM pairs QUALIFY pos <= {POOL}
)"""


@register("neighbour_topk", f"WITH {TOPK_CTE}\nSELECT i, j, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS sim FROM topk")
def neighbour_topk(spark, d):
    return rounded(nb.projection_topk(_vectors(spark, d), k=TOPK), ["sim"])


@register("neighbour_update", ORACLE["neighbour_topk"])
def neighbour_update(spark, d):
    """The index of 99 % of the subjects, extended by the others (the
    reference recomputes its cache when a subject is missing)."""
    v = _vectors(spark, d)
    late = F.pmod(h32(F.col("id")), F.lit(100)) == 0
    old = v.filter(~late)
    index = stored(spark, f"neighbours-old-top{TOPK}", [table_path(d, "embeddings")], lambda: nb.projection_topk(old, k=TOPK))
    return rounded(nb.extend_topk(index, old, v.filter(late), k=TOPK), ["sim"])


@register("close_pool", f"WITH {TOPK_CTE},\n{CLOSE_CTE}\nSELECT rel, subj, cand, CAST(pos AS BIGINT) AS pos FROM close")
def close_pool(spark, d):
    return nb.close_subjects(_topk(spark, d), _members(spark, d), n=POOL, k=TOPK)


def _embedding_examples(spark, d):
    e = table(spark, d, "embeddings")
    subj = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    return e.select(subj.alias("uuid"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("rel"),
                    subj.alias("subj"), F.concat(subj, F.lit(" belongs to group [MASK] .")).alias("x"),
                    F.concat(F.lit("g"), F.col("label").cast("string")).alias("y"))


PRIME_CLOSE_SQL = f"""WITH {TOPK_CTE},
{CLOSE_CTE},
ex AS (
  SELECT 'v' || CAST(vec_id AS VARCHAR) AS uuid, 'g' || CAST(label AS VARCHAR) AS rel,
         'v' || CAST(vec_id AS VARCHAR) AS subj,
         'v' || CAST(vec_id AS VARCHAR) || ' belongs to group [MASK] .' AS x, 'g' || CAST(label AS VARCHAR) AS y
  FROM embeddings
),
pool AS (
  SELECT c.rel, 'v' || CAST(c.subj AS VARCHAR) AS subj, e.x AS p_x, e.y AS p_y,
         row_number() OVER (PARTITION BY c.rel, c.subj ORDER BY c.pos, e.y, e.uuid) - 1 AS idx
  FROM close c JOIN ex e ON e.rel = c.rel AND e.subj = 'v' || CAST(c.cand AS VARCHAR)
  WHERE c.cand <> c.subj
),
sizes AS (SELECT rel, subj, count(*) AS m FROM pool GROUP BY rel, subj),
slots AS (
  SELECT e.uuid, e.rel, e.subj, e.y, s.m, unnest(range(0, least({PRIME_K}, s.m))) AS j
  FROM ex e JOIN sizes s ON e.rel = s.rel AND e.subj = s.subj
),
draws AS (SELECT uuid, rel, subj, j, {"CAST(('0x' || substr(md5(uuid || '|' || y || '|' || '" + str(PRIME_SEED) + "' || '|' || CAST(j AS VARCHAR)), 1, 8)) AS BIGINT)"} % m AS idx FROM slots),
lines AS (
  SELECT d.uuid, d.j, replace(p.p_x, '[MASK]', p.p_y) AS line
  FROM draws d JOIN pool p ON d.rel = p.rel AND d.subj = p.subj AND d.idx = p.idx
),
agg AS (SELECT uuid, string_agg(line, chr(10) ORDER BY j) AS body, count(*) AS n_primes FROM lines GROUP BY uuid)
SELECT e.uuid, e.rel, e.subj, e.y, CAST(coalesce(a.n_primes, 0) AS BIGINT) AS n_primes,
       CASE WHEN a.body IS NULL THEN e.x ELSE a.body || chr(10) || e.x END AS x_primed
FROM ex e LEFT JOIN agg a ON e.uuid = a.uuid"""


@register("priming_close", PRIME_CLOSE_SQL)
def priming_close(spark, d):
    close = nb.close_subjects(_topk(spark, d), _members(spark, d), n=POOL, k=TOPK)
    v = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    pool_subjects = close.select("rel", v("subj").alias("subj"), v("cand").alias("cand"), "pos")
    ex = _embedding_examples(spark, d)
    return pr.prime_from_pool(ex, pool_subjects, k=PRIME_K, seed=PRIME_SEED, priming="nl") \
        .select("uuid", "rel", "subj", "y", "n_primes", "x_primed")
