import math
import os
import random
import tempfile

import pandas as pd

from factlens.operators import continuations as ct


def _brute(sentences, candidates, logits):
    """One call for each (sentence, prefix), by the first candidate by name."""
    out, calls = {}, set()
    for scene, obj, sentence in sentences:
        probs, known = {}, {}
        for c, sub in sorted((c, sub) for s, c, sub in candidates if s == scene):
            best = 0.0
            for i, token in enumerate(sub):
                prefix = tuple(sub[:i])
                if prefix not in known:
                    parts = [p for p in (sentence, "".join(prefix), "<mask>", "".join(sub[i + 1:])) if p]
                    known[prefix] = " ".join(parts) + "\n"
                    calls.add(known[prefix])
                x = logits(known[prefix])
                if token in x:
                    best = max(best, math.exp(x[token]) / sum(map(math.exp, x.values())))
            probs[c] = best
        for c, p in probs.items():
            out[scene, obj, c] = p / sum(probs.values()) if sum(probs.values()) else None
    return out, calls


def test_each_prefix_is_scored_once(spark):
    rng, log = random.Random(3), tempfile.mkdtemp(prefix="trie-", dir=os.environ.get("TMPDIR", "/tmp"))
    names = {s: {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(9)} for s in range(4)}
    candidates = [(s, c, list(c)) for s, x in names.items() for c in x] + [(9, "zz", ["z", "z"]), (9, "z", ["z"])]
    sentences = [(s, f"o{i}", f"it is a {'abcd'[i % 4] * i}" if i else "") for s in range(4) for i in range(3)] + [(9, "o", "x"), (8, "none", "y")]

    def logits(prompt):
        return {t: float(prompt.count(t)) + len(prompt) % 7 / 3 * (t == "b") for t in "abcd"}

    def scorer():
        def score(pdf):
            with open(f"{log}/{os.getpid()}-{random.random()}", "w") as f:
                f.writelines(repr(p) + "\n" for p in pdf["prompt"])
            rows = [(k, t, x) for k, p in zip(pdf["text_key"], pdf["prompt"], strict=True) for t, x in logits(p).items()]
            return pd.DataFrame(rows, columns=["text_key", "token", "logit"])
        return score

    got = ct.continuation_probs(spark.createDataFrame(sentences, "scene long, obj string, sentence string"),
                                spark.createDataFrame(candidates, "scene long, candidate string, sub array<string>"), scorer).collect()
    want, calls = _brute(sentences, candidates, logits)
    assert {(r.scene, r.obj, r.candidate) for r in got} == want.keys()
    for r in got:
        w = want[r.scene, r.obj, r.candidate]
        assert (r.prob is None and w is None) or abs(r.prob - w) < 1e-12
    asked = [x for f in os.listdir(log) for x in open(f"{log}/{f}").read().splitlines()]
    assert sorted(asked) == sorted(map(repr, calls))
