"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P

from factlens.llm import bpe, decontam, simhash
from tests_llm_tools import brute_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    letters = {"aa": "abcdef", "zz": "uvwxyz"}

    def make(lang, n=60):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(1 + rng.randrange(7))) for _ in range(n))

    items = [(k, make("aa", 14)) for k in range(3)]
    texts = [make(("aa", "zz")[k % 2]) for k in range(40)]
    passage = "\n".join(make("aa", 30) for _ in range(3))
    texts[4] += "\n" + passage
    texts[10] += "\n" + passage
    texts[12] = texts[2]
    texts[20] += " " + items[1][1]
    near = make("aa", 700)
    texts += [near, near.replace(near[200:203], "qqq", 1), None, "123 ...", "", "a b c d"]
    rows = [(k, t, ("aa", "zz")[k % 2] if k < 40 else "aa", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    stay = [(k, t) for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    kept = [(d, "\n".join(x)) for d, x in sorted(brute_lines(stay, 200).items()) if x]
    prints = [simhash.fingerprint_of(t) for _, t in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = [kept[k] for k in range(len(kept)) if root[k] == k]
    block = decontam.ItemBlock([(str(i), t) for i, t in items], 10)
    clean = []
    for d, t in kept:
        w = decontam.words_of(t)
        hit = np.zeros(len(w) + 1, bool)
        block.scan([w], hit, np.array([0]), [set()])
        if not hit.any():
            clean.append((d, t))
    model = bpe.ByteBPE(bpe.parse_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), P.PATTERN)

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == [d for d, _ in clean]
    assert 20 not in got and 12 not in got and 10 in got
    for d, t in clean:
        assert bytes(got[d]["token_ids"]) == model.encode_batch([t])[0] and got[d]["round_trip"]


def test_stages_keep_the_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "/root/testdata/sf0.001")
        assert out.schema.simpleString() == empty.schema.simpleString(), name
        assert out.count() == 0


def test_documents_without_any_label_are_kept(spark, tmp_path):
    rows = [(1, "some words", None, "s", 10), (2, "Ελλάδα 漢", None, "s", 8), (3, None, None, "s", 0), (4, "12 !", None, "s", 4), (5, "", None, "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "quite another text of more than a few words to be found here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == [1, 2]
