"""Periodic runs, the source mix and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm import mixing, periodic, queries, running, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- 11 ------------------------------------------------------------------
def brute_runs(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k < len(w) - q:
            j = k
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - k >= q and j - k + q >= least:
                best.setdefault((k, j + q), q)
            k = j + 1
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def sequences(rng):
    u = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
    joint = []
    for _ in range(rng.randrange(2, 5)):  # regions of one period, out of phase
        k = rng.randrange(len(u))
        joint += ((u[k:] + u[:k]) * 60)[:rng.randrange(3, 120)]
    base = list(range(rng.randrange(5, 90)))
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    holes = [0] * rng.randrange(2, 300)
    for _ in range(rng.randrange(5)):
        holes[rng.randrange(len(holes))] = 1 + rng.randrange(2)
    nested = (base[:7] * rng.randrange(1, 5) + base) * rng.randrange(1, 4) + base[:rng.randrange(4, len(base))]
    return [[rng.randrange(2) for _ in range(rng.randrange(2, 250))], joint, (joint + joint)[:500], fib[-1], holes, nested,
            [i.bit_count() % 2 for i in range(200)]]


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_word_sequences(seed):
    for w in sequences(random.Random(seed)):
        for least in (2, 12):
            got = [tuple(x) for x in periodic.find_runs(np.array(w, np.int64), least).tolist()]
            assert got == brute_runs(w, least)


def brute_periodic(text):
    w = WORD.findall(text or "")
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return [(s, e - s, q) for s, e, q in runs], " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_of_a_table(spark):
    long = " ".join(str(i % 913) for i in range(40_000)) + " x " + "a b " * 700
    texts = [None, "", " \n\t", "a " * 40, "a b c " * 9 + "a", "a b " * 20, "one two three", "a " * 40, "x y " * 6 + "z " * 11, "x y " * 5]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    rows = rows.withColumn("Runs", F.lit(1)).withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in periodic.periodic_runs(rows).collect()}
    for i, t in enumerate(texts):
        runs, left = brute_periodic(t)
        assert [tuple(r) for r in got[i]["runs"]] == runs and got[i]["collapsed"] == left
        assert got[i]["n_words"] == len(WORD.findall(t or "")) and got[i]["source"] == "s"
    assert periodic.periodic_runs(rows.limit(0)).count() == 0
    big = periodic.periodic_runs(spark.createDataFrame([(1, long, None)], DOCS)).first()
    assert [tuple(r) for r in big["runs"]] == [(0, 40_000, 913), (40_001, 1400, 2)]
    assert big["collapsed"].split() == [str(i) for i in range(913)] + ["x", "a", "b"]


def test_periodic_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        if n > 1500:
            continue  # brute force is quadratic; a long text is in the test above
        runs, left = brute_periodic(" ".join(w))
        r = got[i]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2]) and r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r["collapsed_sha256"] == sha(left)
        planted += h % 10 == 0 and bool(runs)
    assert planted > 5


# --- 12 ------------------------------------------------------------------
def brute_targets(total, weights=(5, 2, 1), share=1.5, most=2.0):
    """Capping round by round.  ``total``: words by source, in order."""
    budget, w, capped = share * sum(total), [weights[i % len(weights)] for i in range(len(total))], set()
    while True:
        rest = budget - sum(most * total[i] for i in capped)
        free = sum(w[i] for i in range(len(total)) if i not in capped)
        t = [most * total[i] if i in capped else rest * w[i] / free for i in range(len(total))]
        over = {i for i in range(len(total)) if i not in capped and t[i] > most * total[i]}
        if not over:
            return t
        capped |= over


def mixed(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, DOCS), **options).collect()


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * (1 + rng.randrange(5)) for _ in range(rng.choice([0, 1, 7, 40, 900]))),
             rng.choice(["a", "a", "a", "a", "b", "Z", "é", "zz", None])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", None), (402, "x " * 30_000, "b"), (403, "only", "solo"), (404, " \n ", "blank")]
    got = mixed(spark, rows)
    source = {i: s for i, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    words = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = [sum(n for i, n in words.items() if source[i] == s) for s in names]
    want = dict(zip(names, brute_targets(total), strict=True))
    assert {r["id"]: r["size"] for r in got} == words
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == total[names.index(source[r["id"]])] and r["target"] == pytest.approx(want[source[r["id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= len(names) for s in names)
    assert sum(taken.values()) == int(1.5 * sum(total))
    assert sorted(map(tuple, mixed(spark, rows))) == sorted(map(tuple, got))
    other = mixed(spark, rows, seed=5)
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))


def test_mix_is_served_in_proportion_all_along(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(600)]
    sized = mixing.sizes(spark.createDataFrame(rows, DOCS))
    wanted = mixing.targets(sized, weights=(3, 1))
    packets = sorted((r for r in mixing.schedule(sized, wanted).collect() if r["taken"]), key=lambda r: r["place"])
    target = {r["n"]: r["target"] for r in packets}
    given, before = defaultdict(int), 0
    for r in packets:
        assert r["place"] == before
        before += r["taken"]
        given[r["n"]] += r["taken"]
        for n, t in target.items():
            assert abs(given[n] / t - r["finish"]) <= 10 / t + 1e-9
    assert sum(r["epoch"] for r in packets)


def test_mix_of_odd_tables(spark):
    assert mixed(spark, []) == []
    assert sorted((r["size"], r["taken"]) for r in mixed(spark, [(None, None, None), (1, "", "a")])) == [(0, 0), (0, 0)]
    same = mixed(spark, [(7, "a b c d", "s")] * 5)
    assert len(same) == 5 and sum(r["taken"] for r in same) == 30 and all(r["target"] == 30 for r in same)
    extra = spark.createDataFrame([(1, "a b", "s", 5)], DOCS + ", size long")
    assert [r["taken"] for r in mixing.mix(extra).collect()] == [3]


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, 2]), i, rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(7)
    got = running.running_totals(df, ["g"], [F.desc("o")], {"before": F.col("v"), "rank": F.lit(1)}).collect()
    want, seen = {}, defaultdict(lambda: (0, 0))
    for g, o, v in sorted(rows, key=lambda r: -r[1]):
        want[o] = seen[g]
        seen[g] = (seen[g][0] + v, seen[g][1] + 1)
    assert {r["o"]: (r["before"], r["rank"]) for r in got} == want


# --- 13 ------------------------------------------------------------------
def brute_trie(rows, every=20):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    for c, said in conv.items():
        said.sort(key=lambda q: (q[0], q[1], q[2], hashlib.md5(f"{len(q[2])}:{q[2]}{q[3]}".encode()).digest()))
        conv[c] = [(r, x) for _, _, r, x in said]
    new = {}
    for c, said in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = conv.get(c - c % every, [])[:h] + said[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, said in new.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        w = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * w
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    sha(",".join(map(str, sorted(c for c in m if len(new[c]) == len(p)))))) for p, m in members.items()), key=str)


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said, convs = trie.graft(trie.turns(df))
    return sorted((tuple(r) for r in trie.prefix_trie(said, convs).collect()), key=str)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "WIDTHS", (2, 3))
    rng = random.Random(11)
    rows = [(None, 0, "user", "lost")]
    common = [("user" if i % 2 else "assistant", f"turn {i} of all") for i in range(12)]
    for c in range(300):
        kind = c % 6
        said = common[:rng.randrange(13)] if kind < 3 else common[:rng.randrange(13)] + [("user", f"{c} {i}") for i in range(rng.randrange(5))]
        if kind == 5:
            said = [("user", "hi")] * rng.randrange(4)
        rows += [(c, t, r, x) for t, (r, x) in enumerate(said)]
    rows += [(400, None, None, None), (400, 3, "user", ""), (400, 3, "user", ""), (401, 1, "b", "x"), (401, 1, "a", "y"), (401, None, "z", "q")]
    rng.shuffle(rows)
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_copies_of_a_long_conversation(spark):
    rows = [(c, t, "user", f"word {t}") for c in (1000, 1003, 1007, 2001) for t in range(60)]
    rows += [(3000, t, "user", f"alone {t}") for t in range(40)] + [(20, 0, "user", "one"), (21, 0, "user", "one")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    one = [(5, 0, None, None)]
    assert trie_of(spark, one) == brute_trie(one)
    short = [(1, 0, "u", "a"), (21, 0, "u", "a"), (22, 0, "u", "a")]  # turnless ones: their first turns go, none is given
    assert trie_of(spark, short) == brute_trie(short)
