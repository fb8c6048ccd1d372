import os
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from factlens.operators import beliefs as bl
from factlens.operators import runs as rn
from factlens.sources.files import latest_summary
from factlens.streaming import beliefs as sb
from factlens.streaming.summaries import start_summary_stream

OUTCOME_SCHEMA = "scene long, obj string, container string, ts timestamp_ntz, event_id long, success boolean"


def test_stream_state_equals_closed_form(spark):
    rnd = random.Random(2)
    rows, prior_rows = [], []
    for scene in range(8):
        for obj in ("a", "b", "c"):
            prior_rows += [(scene, obj, c, w) for c, w in zip(("x", "y", "z"), (0.2, 0.3, 0.5))]
    for i in range(300):
        c = rnd.choice(("x", "y", "z"))
        rows.append((rnd.randrange(8), rnd.choice(("a", "b", "c")), c, i, c == "z" and rnd.random() < 0.5))
    base = tempfile.mkdtemp(prefix="stream-", dir=os.environ.get("TMPDIR", "/tmp"))
    src = os.path.join(base, "in")
    df = spark.createDataFrame(rows, "scene long, obj string, container string, t long, success boolean") \
        .select("scene", "obj", "container", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"),
                F.col("t").alias("event_id"), "success")
    # three files arrive: three micro-batches
    for part in range(3):
        df.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(OUTCOME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = sb.start_belief_stream(stream, os.path.join(base, "snap"), os.path.join(base, "ck"))
    q.awaitTermination()
    assert spark.read.parquet(os.path.join(base, "snap")).select("batch_id").distinct().count() == 3
    snaps = sb.latest_snapshots(spark.read.parquet(os.path.join(base, "snap")))
    prior = spark.createDataFrame(prior_rows, "scene long, obj string, container string, p double")
    stream_b = {(r.scene, r.obj, r.container): r.p for r in sb.beliefs_from_state(prior, snaps).collect()}
    outc = df.select("scene", "obj", "container", "ts", "event_id", "success")
    batch_b = {(r.scene, r.obj, r.container): r.p for r in bl.update(prior, outc, ["ts", "event_id"]).collect()}
    assert stream_b.keys() == batch_b.keys()
    for k, v in batch_b.items():
        assert (v is None and stream_b[k] is None) or np.isclose(v, stream_b[k])


def test_summary_stream_upserts(spark):
    base = tempfile.mkdtemp(prefix="sumstream-", dir=os.environ.get("TMPDIR", "/tmp"))
    runs_path = os.path.join(base, "runs")
    schema = ("model string, num_examples bigint, priming_type string, use_close_examples boolean, random_seed bigint, "
              "rel string, p_at_1 boolean, p_at_3 boolean, p_at_5 boolean, p_at_10 boolean, p_at_20 boolean, "
              "mrr double, target_likelihood double")
    rels = spark.createDataFrame([("r1", "t", "N-1"), ("r2", "t", "1-1")], "rel string, template string, type string")

    def batch(seed, hit):
        return [("m", 0, "nl", False, seed, r, hit, hit, hit, hit, hit, float(hit), 0.5) for r in ("r1", "r2")]
    spark.createDataFrame(batch(0, True) + batch(1, False), schema).write.mode("append").parquet(runs_path)
    q = start_summary_stream(spark, runs_path, schema, rels, "D", os.path.join(base, "summary"), os.path.join(base, "ck"))
    q.awaitTermination()
    spark.createDataFrame(batch(1, True), schema).write.mode("append").parquet(runs_path)   # seed 1 rerun
    q = start_summary_stream(spark, runs_path, schema, rels, "D", os.path.join(base, "summary"), os.path.join(base, "ck"))
    q.awaitTermination()
    s = latest_summary(spark, os.path.join(base, "summary"))
    got = {(r.data, r.random_seed): r.p_at_1 for r in s.collect()}
    assert got[("D", 0)] == 1.0 and got[("D", 1)] == 1.0 and got[("D_N-1", 1)] == 1.0
    assert s.count() == 6                                   # 2 seeds x (total + 2 types), keys unique
    assert {r.ingest_seq for r in s.filter(F.col("random_seed") == 1).collect()} == {2}
    assert rn is not None


def test_summary_stream_of_a_run_in_two_batches_equals_the_batch_summary(spark):
    base = tempfile.mkdtemp(prefix="sumsplit-", dir=os.environ.get("TMPDIR", "/tmp"))
    runs_path = os.path.join(base, "runs")
    schema = ("model string, num_examples bigint, priming_type string, use_close_examples boolean, random_seed bigint, "
              "uuid string, rel string, p_at_1 boolean, p_at_3 boolean, p_at_5 boolean, p_at_10 boolean, p_at_20 boolean, "
              "mrr double, target_likelihood double")
    rels = spark.createDataFrame([("r1", "t", "N-1")], "rel string, template string, type string")

    def rows(hits):
        return spark.createDataFrame([("m", 0, "nl", False, 0, u, "r1", h, h, h, h, h, float(h), 0.5) for u, h in hits], schema)
    for part in ([("u1", True), ("u2", True), ("u3", True)], [("u4", False), ("u3", True)]):
        rows(part).coalesce(1).write.mode("append").parquet(runs_path)
        start_summary_stream(spark, runs_path, schema, rels, "D", os.path.join(base, "summary"), os.path.join(base, "ck"),
                             row_key="uuid").awaitTermination()
    want = rn.summarize(rows([("u1", True), ("u2", True), ("u3", True), ("u4", False)]), rels, "D")
    got = {r["data"]: r["p_at_1"] for r in latest_summary(spark, os.path.join(base, "summary")).collect()}
    assert got == {r["data"]: r["p_at_1"] for r in want.collect()} == {"D": 0.75, "D_N-1": 0.75}


def _summary_schema():
    return ("model string, num_examples bigint, priming_type string, use_close_examples boolean, random_seed bigint, "
            "uuid string, rel string, p_at_1 boolean, p_at_3 boolean, p_at_5 boolean, p_at_10 boolean, p_at_20 boolean, "
            "mrr double, target_likelihood double")


def test_summary_stream_takes_up_split_repeated_and_replaced_files(spark):
    base = tempfile.mkdtemp(prefix="summerge-", dir=os.environ.get("TMPDIR", "/tmp"))
    runs_path, rnd = os.path.join(base, "runs"), random.Random(4)
    rels = spark.createDataFrame([(f"r{i}", "t", "N-1" if i % 2 else "1-1") for i in range(4)], "rel string, template string, type string")
    last = {}

    def some(seeds, uuids):
        rows = []
        for s in seeds:
            for u in uuids:
                h = rnd.random() < 0.5
                rows.append(("m", 1, None if s == 2 else "nl", False, s, f"u{u}", f"r{(u + (rnd.random() < 0.1)) % 4}", h, h, True, True, True,
                             rnd.random(), rnd.random() / 3))
        last.update({(r[2], r[4], r[5]): r for r in rows})
        return rows

    def send(rows):
        spark.createDataFrame(rows, _summary_schema()).coalesce(1).write.mode("append").parquet(runs_path)

    def run():
        start_summary_stream(spark, runs_path, _summary_schema(), rels, "D", os.path.join(base, "summary"), os.path.join(base, "ck"),
                             row_key="uuid").awaitTermination()

    first = some((0, 1, 2), range(12))
    send(first)
    send(some((0,), range(12, 20)))            # split
    run()
    send(first[:5])                            # repeated: equal rows of a later file
    last.update({(r[2], r[4], r[5]): r for r in first[:5]})
    send(some((1,), range(0, 15)))             # replaced, some in another relation
    run()
    want = rn.summarize(spark.createDataFrame(list(last.values()), _summary_schema()), rels, "D").collect()
    got = latest_summary(spark, os.path.join(base, "summary")).collect()

    def by_key(rows):
        return {(r["data"], r["priming_type"] or "", r["random_seed"]): (r["n_relations"], r["p_at_1"], r["mrr"], r["target_likelihood"]) for r in rows}

    got, want = by_key(got), by_key(want)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_belief_stream_goes_on_from_a_table_with_late_and_repeated_attempts(spark):
    base = tempfile.mkdtemp(prefix="late-", dir=os.environ.get("TMPDIR", "/tmp"))
    src, snap, rnd = os.path.join(base, "in"), os.path.join(base, "snap"), random.Random(8)
    rows = [(rnd.randrange(3), rnd.choice("ab"), rnd.choice("xyz"), i, rnd.random() < 0.2) for i in range(120)]
    df = spark.createDataFrame(rows, "scene long, obj string, container string, t long, success boolean") \
        .select("scene", "obj", "container", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), F.col("t").alias("event_id"), "success")
    table = df.filter("event_id < 40")
    # the newest come first, then late ones, then some twice
    for part in ("event_id >= 100", "event_id between 40 and 79", "event_id between 70 and 104"):
        df.filter(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(OUTCOME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = sb.start_belief_stream(stream, snap, os.path.join(base, "ck"), initial=sb.initial_state(table), compact_every=2)
        q.awaitTermination()                       # each run is a restart from the checkpoint
    assert os.listdir(snap + "-compact") == ["upto=1"]
    prior = spark.createDataFrame([(s, o, c, 1 / 3) for s in range(3) for o in "ab" for c in "xyz"], "scene long, obj string, container string, p double")
    seen = df.select("scene", "obj", "container", "ts", "event_id", "success")
    stream_b = {(r.scene, r.obj, r.container): r.p for r in sb.beliefs_from_state(prior, sb.snapshots(spark, snap)).collect()}
    batch_b = {(r.scene, r.obj, r.container): r.p for r in bl.update(prior, seen, ["ts", "event_id"]).collect()}
    assert stream_b.keys() == batch_b.keys()
    for k, v in batch_b.items():
        assert (v is None and stream_b[k] is None) or np.isclose(v, stream_b[k])
    assert sorted(r["batch_id"] for r in spark.read.parquet(snap).select("batch_id").distinct().collect()) == [0, 1, 2]
