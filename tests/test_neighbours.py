import numpy as np

from factlens.operators import neighbours as nb


def _brute(vecs, k):
    ids = np.arange(len(vecs))
    S = (vecs @ vecs.T) / np.einsum("ij,ij->i", vecs, vecs)[None, :]
    out = {}
    for i in ids:
        order = sorted(ids, key=lambda j: (-S[i, j], j))[:k]
        out[i] = [(int(j), S[i, j]) for j in order]
    return out


def test_blocked_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = nb.projection_topk(df, k=7, block_rows=16).collect()   # 4 blocks -> 16 cells
    ref = _brute(vecs, 7)
    by = {}
    for r in got:
        by.setdefault(r.i, []).append((r.rank, r.j, r.sim))
    for i, lst in by.items():
        lst.sort()
        assert [j for _, j, _ in lst] == [j for j, _ in ref[i]]
        assert np.allclose([s for _, _, s in lst], [s for _, s in ref[i]])


def test_close_subjects_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(40, 4))
    labels = [i % 2 for i in range(40)]
    k, n = 5, 6
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")
    members = spark.createDataFrame([(f"g{labels[i]}", i) for i in range(40)], "rel string, id long")
    close = nb.close_subjects(nb.projection_topk(df, k=k), members, n=n, k=k).collect()
    ref = _brute(vecs, k)
    for i in range(40):
        same = [j for j in range(40) if labels[j] == labels[i]]
        pos = {j: r for r, (j, _) in enumerate(ref[i])}
        key = lambda j: (1000 if j == i else pos.get(j, 400), j)
        want = sorted(same, key=key)[:n]
        got = [r.cand for r in sorted((r for r in close if r.subj == i), key=lambda r: r.pos)]
        assert got == want


def _frame(spark, ids, vecs):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vecs, strict=True)], "id long, vec array<double>")


def _lists(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r.i, r["rank"])):
        by.setdefault(r.i, []).append((r.j, round(r.sim, 9)))
    return by


def _clustered(n, spread=0.05, seed=3):
    """Groups of directions with different norms, ties (equal vectors) and a null vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 6))
    vecs = centres[np.arange(n) % 8] + spread * rng.normal(size=(n, 6))
    vecs *= np.array([1.0, 4.0, 0.5])[np.arange(n) % 3][:, None]
    vecs[10] = vecs[18] = vecs[2]
    vecs[7] = 0.0
    return vecs


def test_pruned_search_equals_all_pairs_and_skips_cells(spark):
    vecs = _clustered(400)
    df = _frame(spark, range(400), vecs)
    want = _lists(nb.projection_topk(df, k=9).collect())
    with np.errstate(divide="ignore", invalid="ignore"):
        S = (vecs @ vecs.T) / np.einsum("ij,ij->i", vecs, vecs)[None, :]
    S = np.where(np.isnan(S), -np.inf, S)
    for i in range(400):
        order = sorted(range(400), key=lambda j: (-round(S[i, j], 12), j))[:9]
        assert [round(s, 9) for _, s in want[i]] == [round(S[i, j], 9) for j in order]
    found = nb.search(df, k=9, block_rows=16, prune_rows=0)
    assert _lists(found.topk.collect()) == want
    assert 0 < found.formed < 0.7 * found.cells


def test_pruned_search_of_random_small_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(90, 4))
    df = _frame(spark, range(90), vecs)
    assert _lists(nb.projection_topk(df, k=7, block_rows=8, prune_rows=0).collect()) == _lists(nb.projection_topk(df, k=7).collect())
    assert len(nb.projection_topk(df.limit(3), k=7, prune_rows=0).collect()) == 9
    zero = _frame(spark, range(4), np.zeros((4, 3)))
    assert [len(x) for x in _lists(nb.projection_topk(zero, k=2, prune_rows=0).collect()).values()] == [2] * 4
    assert nb.projection_topk(df.limit(0), k=7).count() == 0


def test_extended_index_equals_a_full_one(spark):
    vecs = _clustered(200, spread=1.0)
    old, new = _frame(spark, range(190), vecs[:190]), _frame(spark, range(185, 200), vecs[185:])
    got = nb.extend_topk(nb.projection_topk(old, k=11), old, new, k=11, block_rows=64)
    want = nb.projection_topk(_frame(spark, range(200), vecs), k=11)
    assert _lists(got.collect()) == _lists(want.collect())
    same = nb.extend_topk(nb.projection_topk(old, k=11), old, old, k=11)
    assert _lists(same.collect()) == _lists(nb.projection_topk(old, k=11).collect())


def test_lists_leave_a_task_whole_and_tasks_stay_many(spark):
    """Small vectors aren't drawn together into one task, and no pairs of blocks are ranked behind it."""
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(50, 3))
    found = nb.projection_topk(_frame(spark, range(50), vecs), k=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    got = {i: [j for j, _ in x] for i, x in _lists(found.collect()).items()}
    assert got == {int(i): [int(j) for j, _ in x] for i, x in _brute(vecs, 4).items()}
