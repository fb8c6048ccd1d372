import random

from factlens.operators import beliefs as bl
from factlens.operators import nearest as nr


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _typo(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abcdé") + s[i:], s[:i] + s[i + 1:], s[:i] + "z" + s[i + 1:]])
    return s


def _tables(seed):
    rng = random.Random(seed)
    names = [(s, "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 14)))) for s in (1, 1, 1, 2) for _ in range(60)] + [(1, ""), (3, "only")]
    held = [(s, i, _typo(rng, t, rng.randrange(6))) for i, (s, t) in enumerate(rng.choice(names) for _ in range(120))]
    return names, held + [(1, 500, ""), (1, 501, "x" * 30), (1, 502, "x" * 30), (3, 503, "ony"), (9, 504, "nobody")]


def _brute(names, held):
    out = {}
    for s, i, t in held:
        options = sorted((_distance(n, t), n) for x, n in set(names) if x == s)
        if options:
            out[i] = (t, options[0][1], options[0][0])
    return out


def test_nearest_names_by_segments_equal_all_pairs(spark):
    for seed, radii in ((1, (1, 2, 4)), (2, (3,)), (3, (1, 2, 4, 8, 16, 32))):
        names, held = _tables(seed)
        h = spark.createDataFrame(held, "scene long, item_id long, held string")
        n = spark.createDataFrame(names, "scene long, name string")
        got = {r.item_id: (r.held, r.nearest, r.distance) for r in bl.nearest_name(h, n, radii=radii, few=1).collect()}
        assert got == _brute(names, held)


def test_a_crowded_scene_is_not_crossed_with_its_texts(spark):
    rng = random.Random(0)
    names = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(20_000)})
    held = [(1, i, _typo(rng, rng.choice(names), 2)) for i in range(300)]
    n = spark.createDataFrame([(1, x) for x in names], "scene long, name string")
    h = spark.createDataFrame(held, "scene long, item_id long, held string")
    got = {r.item_id: r.distance for r in bl.nearest_name(h, n).collect()}
    assert len(got) == 300 and max(got.values()) <= 2
    near = nr.within(h.selectExpr("scene", "held as text").distinct(), n, 2)
    assert near.count() == len({t for _, _, t in held})
