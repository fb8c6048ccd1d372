"""Embedding analytics over the embeddings table (label = relation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.operators import embeddings as em
from factlens.plans import sqlparts as sq
from factlens.plans.common import rounded
from factlens.sources.tables import table

QUERIES, ORACLE = {}, {}
LABELS = list(range(8))    # the relation subset shown in the view
N_PER_GROUP, SEED, N_STD = 50, 0, 2.0
SQUARINGS = 30             # of the covariance matrix, in the SQL twin of the principal components


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SAMPLE_CTES = f"""e AS (
  SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS c
  FROM embeddings WHERE label IN ({", ".join(map(str, LABELS))})
),
firsts AS (SELECT label, rn - 1 AS slot, vec_id, embedding FROM e WHERE rn <= {N_PER_GROUP}),
fill AS (SELECT label, c, unnest(range(c, {N_PER_GROUP})) AS slot FROM (SELECT DISTINCT label, c FROM e WHERE c < {N_PER_GROUP})),
picks AS (
  SELECT f.label, f.slot, e.vec_id, e.embedding FROM fill f
  JOIN e ON e.label = f.label AND e.rn = {sq.HS("'balanced'", 'f.label', 'f.slot', str(SEED))} % f.c + 1
),
sample AS (SELECT * FROM firsts UNION ALL SELECT * FROM picks)"""


@register("balanced_sample", f"WITH {SAMPLE_CTES}\nSELECT label, CAST(slot AS BIGINT) AS slot, vec_id FROM sample")
def balanced_sample(spark, d):
    e = table(spark, d, "embeddings").filter(F.col("label").isin(*LABELS))
    return em.balanced_sample(e, "label", "vec_id", N_PER_GROUP, SEED, LABELS).select("label", "slot", "vec_id")


@register("centroids", """WITH ex AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM ex GROUP BY label, dim""")
def centroids(spark, d):
    return rounded(em.centroids_long(table(spark, d, "embeddings"), "label", "embedding"), ["mean"])


def _axis_ctes(name: str, matrix: str) -> str:
    """The first principal axis of a covariance matrix by repeated squaring;
    its largest entry by size is positive."""
    return f"""{name}_power AS (
  SELECT 0 AS k, m FROM {matrix}
  UNION ALL
  SELECT k + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / f))
  FROM (SELECT k, m, list_sum(list_transform(m, lambda a: list_dot_product(a, a))) AS f FROM {name}_power WHERE k < {SQUARINGS})
),
{name} AS (
  SELECT list_transform(r, lambda x: x * s / n) AS a
  FROM (SELECT r, sqrt(list_dot_product(r, r)) AS n, CASE WHEN list_max(r) >= -list_min(r) THEN 1.0e0 ELSE -1.0e0 END AS s
        FROM (SELECT unnest(m) AS r FROM {name}_power WHERE k = {SQUARINGS}))
  ORDER BY n DESC LIMIT 1
)"""


PCA_CTES = f"""pts AS (SELECT 'point' AS kind, label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
means AS (
  SELECT label, dim, avg(x) AS mean
  FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM pts) GROUP BY label, dim
),
shown AS (
  SELECT * FROM pts UNION ALL SELECT 'centroid', label, NULL, list(mean ORDER BY dim) FROM means GROUP BY label
),
entries AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM (SELECT row_number() OVER () AS r, v FROM shown)),
middle AS (SELECT list(c ORDER BY dim) AS mu FROM (SELECT dim, avg(x) AS c FROM entries GROUP BY dim)),
cov AS (
  SELECT list(c ORDER BY i) AS m FROM (
    SELECT i, list(c ORDER BY j) AS c FROM (
      SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS c FROM entries a JOIN entries b ON a.r = b.r GROUP BY a.dim, b.dim)
    GROUP BY i)
),
{_axis_ctes('axis1', 'cov')},
deflated AS (
  SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * a[i] * a[j])) AS m
  FROM (SELECT m, a, list_dot_product(a, list_transform(m, lambda r: list_dot_product(r, a))) AS l FROM cov, axis1)
),
{_axis_ctes('axis2', 'deflated')},
projected AS (
  SELECT kind, label, vec_id, list_dot_product(c, axis1.a) AS pc1, list_dot_product(c, axis2.a) AS pc2
  FROM (SELECT kind, label, vec_id, list_transform(v, lambda x, i: x - mu[i]) AS c FROM shown, middle), axis1, axis2
)"""


def _projected(spark, d):
    """All vectors and one centroid row per label, centred and projected on
    two principal components."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    points = e.select(F.lit("point").alias("kind"), "label", "vec_id", "v")
    means = em.centroids(e, "label", "v").select(
        F.lit("centroid").alias("kind"), "label", F.lit(None).cast(e.schema["vec_id"].dataType).alias("vec_id"), F.col("centroid").alias("v"))
    return em.pca_2d(points.unionByName(means), "v").drop("v")


ELLIPSE_COLS = ["mean_x", "mean_y", "var_x", "var_y", "cov_xy", "pearson", "radius_x", "radius_y", "scale_x", "scale_y"]


@register("ellipse_params", f"""WITH RECURSIVE {PCA_CTES},
a AS (SELECT label, count(*) AS n, avg(pc1) AS mean_x, avg(pc2) AS mean_y, var_samp(pc1) AS var_x, var_samp(pc2) AS var_y,
             covar_samp(pc1, pc2) AS cov_xy FROM projected WHERE kind = 'point' GROUP BY label),
b AS (SELECT *, cov_xy / sqrt(var_x * var_y) AS pearson FROM a)
SELECT label, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(var_x, 6) AS var_x,
       round(var_y, 6) AS var_y, round(cov_xy, 6) AS cov_xy, round(pearson, 6) AS pearson,
       round(sqrt(1.0e0 + pearson), 6) AS radius_x, round(sqrt(1.0e0 - pearson), 6) AS radius_y,
       round({N_STD}e0 * sqrt(var_x), 6) AS scale_x, round({N_STD}e0 * sqrt(var_y), 6) AS scale_y
FROM b""")
def ellipse_params(spark, d):
    points = _projected(spark, d).filter(F.col("kind") == "point")
    return rounded(em.ellipse(points, "label", "pc1", "pc2", N_STD), ELLIPSE_COLS)


@register("pca_2d", f"""WITH RECURSIVE {PCA_CTES}
SELECT kind, label, vec_id, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2 FROM projected""")
def pca_2d(spark, d):
    return rounded(_projected(spark, d), ["pc1", "pc2"])
