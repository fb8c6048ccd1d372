from pyspark.sql import functions as F

from factlens.operators import examples as ex

RELS = [("P1", "[X] is in [Y] .", "N-1"), ("P2", "[X] shares border with [Y] .", "N-M")]


def _rels(spark):
    return spark.createDataFrame(RELS, "rel string, template string, type string")


def test_dedup_happens_before_validity(spark):
    long_subj = " ".join(["w"] * 100)
    facts = spark.createDataFrame([
        ("P1", long_subj, "Paris", "u1"),      # first copy is too long (102 tokens)
        ("P1", long_subj, "Paris", "u2"),      # later duplicate is dropped with it
        ("P1", "", "Paris", "u3"),             # empty subject
        ("P1", "Rome", "Lazio", "u4"),         # answer out of vocabulary
        ("P1", "Oslo", "norway", "u5"),        # case mismatch with vocabulary
        ("P1", "Bern", "Paris", "u6"),         # valid
    ], "rel string, subj string, obj string, uuid string")
    vocab = spark.createDataFrame([("Paris",), ("Norway",)], "token string")
    filled = ex.fill_templates(facts, _rels(spark))
    d = ex.dedup_examples(filled)
    assert d.filter(F.col("subj") == long_subj).first().uuid == "u1"
    v = ex.valid_examples(d, vocab)
    assert sorted(r.uuid for r in v.collect()) == ["u6"]


def test_token_bound_is_inclusive(spark):
    subj99 = " ".join(["w"] * 96)   # template adds 4 tokens: 100 in all
    subj100 = " ".join(["w"] * 97)
    facts = spark.createDataFrame([("P1", subj99, "Paris", "a"), ("P1", subj100, "Paris", "b")],
                                  "rel string, subj string, obj string, uuid string")
    vocab = spark.createDataFrame([("Paris",)], "token string")
    v = ex.valid_examples(ex.dedup_examples(ex.fill_templates(facts, _rels(spark))), vocab)
    assert [r.uuid for r in v.collect()] == ["a"]


def test_unknown_relation_raises(spark):
    facts = spark.createDataFrame([("P9", "a", "b", "u")], "rel string, subj string, obj string, uuid string")
    try:
        ex.fill_templates(facts, _rels(spark)).collect()
    except Exception as e:  # noqa: BLE001
        assert "unknown relation" in str(e)
    else:
        raise AssertionError("expected an error")


def test_other_solutions_from_raw_rows(spark):
    raw = spark.createDataFrame([
        ("P2", "France", "Spain", "1"), ("P2", "France", "Italy", "2"), ("P2", "France", "Spain", "3"),
        ("P2", "France", "Atlantis", "4"), ("P1", "Bern", "Paris", "5"),
    ], "rel string, subj string, obj string, uuid string")
    e = ex.dedup_examples(ex.fill_templates(raw, _rels(spark)))
    o = {(r.subj, r.y): r.other_solutions for r in ex.other_solutions(raw, e, _rels(spark)).collect()}
    assert o[("France", "Spain")] == ["Atlantis", "Italy"]
    assert o[("France", "Italy")] == ["Atlantis", "Spain"]
    assert o[("Bern", "Paris")] == []


def test_known_answers_and_solvable_relations(spark):
    rows = spark.createDataFrame([("r1", "a", ["x", "Q", "y"]), ("r1", "b", ["z"]), ("r2", "c", []), ("r2", "d", None)],
                                 "rel string, subj string, answers array<string>")
    known = ex.known_answers(rows, spark.createDataFrame([("X",), ("y",)], "token string"))
    assert {r.subj: (r.y, r.solvable) for r in known.collect()} == {"a": (["x", "y"], True), "b": ([], False), "c": ([], False), "d": ([], False)}
    assert {r.subj for r in ex.solvable_relations(known).collect()} == {"a", "b"}


def test_first_occurrence_deals_rows_into_bounded_tasks(spark, monkeypatch):
    """Above TASK_ROWS rows no task sorts more than its share; the rows are the same, for a frequent and a null key too."""
    rows = [("P1" if i % 3 else "P2", f"s{i % 7}" if i % 2 else "often", None if i % 5 == 0 else "y", f"u{(i * 37) % 400:03d}", i)
            for i in range(400)]
    df = spark.createDataFrame(rows, "rel string, subj string, y string, uuid string, v int").repartition(2)
    want = sorted(map(str, ex.first_occurrence(df, ["rel", "subj", "y"], "uuid", df.columns).collect()))
    monkeypatch.setattr(ex, "TASK_ROWS", 20)
    dealt = ex.first_occurrence(df, ["rel", "subj", "y"], "uuid", df.columns)
    assert sorted(map(str, dealt.collect())) == want
    assert dealt.rdd.getNumPartitions() == 20
