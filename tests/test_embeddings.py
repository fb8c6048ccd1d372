import pytest
import numpy as np
from pyspark.sql import functions as F

from factlens.operators import embeddings as em


def _df(spark, sizes, dim=4, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            rows.append((i, g, [float(x) for x in rng.normal(size=dim)]))
            i += 1
    return spark.createDataFrame(rows, "id long, g string, v array<double>"), rows


def test_balanced_sample_cuts_and_fills(spark):
    df, _ = _df(spark, {"small": 3, "big": 12})
    s = em.balanced_sample(df, "g", "id", n=5, seed=1).collect()
    by = {}
    for r in s:
        by.setdefault(r.g, []).append(r)
    assert len(by["small"]) == 5 and len(by["big"]) == 5
    assert sorted(r.id for r in by["big"]) == [3, 4, 5, 6, 7]                  # first n in row order
    assert {r.id for r in by["small"]} <= {0, 1, 2} and sorted(r.slot for r in by["small"]) == [0, 1, 2, 3, 4]


def test_ellipse_matches_numpy(spark):
    df, rows = _df(spark, {"a": 30, "b": 25}, dim=2)
    e = {r.g: r for r in em.ellipse(df.select("g", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")),
                                   "g", "x", "y", 2.0).collect()}
    for g in ("a", "b"):
        xy = np.array([r[2] for r in rows if r[1] == g])
        cov = np.cov(xy[:, 0], xy[:, 1])
        r = cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])
        assert np.isclose(e[g].pearson, r) and np.isclose(e[g].radius_x, np.sqrt(1 + r))
        assert np.isclose(e[g].scale_y, 2 * np.sqrt(cov[1, 1])) and np.isclose(e[g].mean_x, xy[:, 0].mean())


def test_centroids(spark):
    df, rows = _df(spark, {"a": 7, "b": 4})
    c = {r.g: r.centroid for r in em.centroids(df, "g", "v").collect()}
    for g in ("a", "b"):
        assert np.allclose(c[g], np.mean([r[2] for r in rows if r[1] == g], axis=0))


def test_pca_matches_numpy_up_to_sign(spark):
    df, rows = _df(spark, {"a": 40}, dim=5, seed=3)
    got = sorted((r.id, r.pc1, r.pc2) for r in em.pca_2d(df, "v").collect())
    X = np.array([r[2] for r in rows])
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    ref = Xc @ vt[:2].T
    for c in range(2):
        col = np.array([g[1 + c] for g in got])
        assert np.allclose(col, ref[:, c]) or np.allclose(col, -ref[:, c])
        sign = 1 if vt[c].max() >= -vt[c].min() else -1
        assert np.allclose(col, sign * ref[:, c])


def test_balanced_sample_asks_for_its_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, id long")
    assert em.balanced_sample(df, "g", "id", 2, groups=["a", "b"]).count() == 4
    with pytest.raises(Exception, match="no rows for the group: c"):
        em.balanced_sample(df, "g", "id", 2, groups=["a", "c"]).select("id").collect()
