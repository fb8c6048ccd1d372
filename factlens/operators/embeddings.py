"""Embedding-group summaries: balanced samples, centroids, 2-D projection,
covariance ellipses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.hashing import h32


def balanced_sample(df: DataFrame, group: str, order: str, n: int, seed: int = 0, groups: list | None = None) -> DataFrame:
    """Exactly n rows per group: the first n in ``order``, and for smaller
    groups the missing slots drawn with replacement from the group (hash of
    group, slot and seed).  Output adds ``slot`` (0..n-1).  A group of another
    size is an error, and so is a value of ``groups`` (where given) without rows.

    The ``rank <= n`` filter is planned as a WindowGroupLimit, which cuts
    each group to n rows before the shuffle, so a huge group costs nothing.
    """
    w = Window.partitionBy(group).orderBy(order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    firsts = ranked.withColumn("slot", (F.col("_rn") - 1).cast("bigint"))
    sizes = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") < n)
    slots = sizes.select(group, "_c", F.explode(F.sequence(F.col("_c"), F.lit(n - 1))).alias("slot"))
    draws = slots.select(group, F.col("slot").cast("bigint").alias("slot"),
                         (F.pmod(h32(F.lit("balanced"), F.col(group), F.col("slot"), F.lit(seed)), F.col("_c")) + 1)
                         .alias("_rn"))
    fills = draws.join(ranked, [group, "_rn"])
    out = firsts.unionByName(fills).drop("_rn")
    cnt = F.count(F.lit(1)).over(Window.partitionBy(group))
    def fails(text):
        return F.raise_error(F.concat(F.lit(text), F.col(group).cast("string"))).cast("boolean")

    # as filters: a check in a column goes where the column isn't read
    wrong = "group does not hold the requested number of rows: "
    out = out.withColumn("_n", cnt).filter(F.when(F.col("_n") == n, True).otherwise(fails(wrong))).drop("_n")
    if groups is None:
        return out
    kind = df.schema[group].dataType.simpleString()
    asked = df.sparkSession.createDataFrame([(g,) for g in groups], f"`{group}` {kind}")
    present = df.select(group).distinct().withColumn("_has", F.lit(True))
    absent = asked.join(present, group, "left").filter(F.when(F.col("_has"), False).otherwise(fails("no rows for the group: ")))
    return out.unionByName(absent.drop("_has"), allowMissingColumns=True)


def centroids_long(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise mean vector per group, long form (group, dim, mean)."""
    e = df.select(group, F.posexplode(vec).alias("dim", "v"))
    return e.groupBy(group, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise mean vector per group as an array (ordered by dimension;
    the regroup holds one value per dimension)."""
    lg = centroids_long(df, group, vec)
    return lg.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("_m")) \
             .select(group, F.col("_m.mean").alias("centroid"))


def ellipse(df: DataFrame, group: str, x: str, y: str, n_std: float = 2.0) -> DataFrame:
    """Covariance confidence ellipse per group: centre, sample (co)variances,
    Pearson r, unit radii sqrt(1 +/- r) and axis scales n_std * sd."""
    a = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov_xy"))
    r = F.col("cov_xy") / F.sqrt(F.col("var_x") * F.col("var_y"))
    return a.withColumn("pearson", r) \
            .withColumn("radius_x", F.sqrt(F.lit(1.0) + F.col("pearson"))) \
            .withColumn("radius_y", F.sqrt(F.lit(1.0) - F.col("pearson"))) \
            .withColumn("scale_x", F.lit(n_std) * F.sqrt("var_x")) \
            .withColumn("scale_y", F.lit(n_std) * F.sqrt("var_y"))


def pca_2d(df: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """Project vectors on their first k principal components after centring
    (Spark's PCA does not centre the projection itself).  Each component's
    largest loading by size is positive.  Adds pc1..pck."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v).transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    signs = [1.0 if c.max() >= -c.min() else -1.0 for c in model.pc.toArray().T]  # dimensions x k numbers
    proj = model.transform(centred)
    arr = vector_to_array(F.col("_p"))
    return proj.select(*df.columns, *[(arr[i] * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(k)])
