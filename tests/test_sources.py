import os
import tempfile

from pyspark.sql import functions as F

from factlens.sources import files as fl


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_relations_last_duplicate_wins(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    _write(f"{d}/relations.jsonl", '{"relation": "P1", "template": "old [X] [Y]", "type": "N-1"}\n'
                                   '{"relation": "P2", "template": "[X] b [Y]", "type": "N-M"}\n'
                                   '{"relation": "P1", "template": "new [X] [Y]", "type": "1-1"}\n')
    r = {x.rel: x for x in fl.read_relations(spark, f"{d}/relations.jsonl").collect()}
    assert r["P1"].template == "new [X] [Y]" and r["P1"].type == "1-1" and r["P2"].type == "N-M"


def test_bats_files_and_vocab(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    _write(f"{d}/1_Inflectional/I01 [noun - plural_reg].txt", "cat\tcats\ndog\tdogs/doggies\n")
    _write(f"{d}/vocab.txt", "cats\n a b\ndogs\n")
    b = sorted(fl.read_bats(spark, d).collect(), key=lambda r: r.uuid)
    assert [(r.rel, r.x, r.answers, r.uuid) for r in b] == [("I01", "cat", ["cats"], "I01_0"),
                                                            ("I01", "dog", ["dogs", "doggies"], "I01_1")]
    assert [r.token for r in fl.read_vocab(spark, f"{d}/vocab.txt").collect()] == ["cats", " a b", "dogs"]
    n = fl.read_category_names(spark, d).first()
    assert n.category == "I01" and n.name == "I01 [noun - plural_reg]"


def test_run_files_are_discovered_and_parsed(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    csv = '_index,x,y,uuid,y_pred,y_pred_prob\n0,"a\nb [MASK]",Paris,u1,"[\'Paris\', ""it\'s""]","[0.5, 2e-05]"\n'
    _write(f"{d}/TREx/bert-base-cased/pe-3_nl-True_ce-False_rs-0.csv", csv)
    _write(f"{d}/summary.csv", "data,p@1\nTREx,0.1\n")
    runs = fl.read_runs(spark, d).collect()
    assert len(runs) == 1
    r = runs[0]
    assert (r.data, r.model, r.num_examples, r.priming_type, r.use_close_examples, r.random_seed) == \
        ("TREx", "bert-base-cased", 3, "nl", False, 0)
    assert r.y_pred == ["Paris", "it's"] and r.y_pred_prob == [0.5, 2e-05] and r.x == "a\nb [MASK]"
    assert r.targets == ["Paris"] and not r.parse_failed


def test_episode_log_and_baselines(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    _write(f"{d}/results.txt", "games:g/hard/test,agent:lmkb,lm:m,priming_template:arrow,num_priming_examples:3,"
                               "score:0.5,steps:44.0\n")
    _write(f"{d}/glove.txt", "I01 558\nD01 5\n")
    _write(f"{d}/solvable.txt", "I01\t40\n")
    e = fl.read_episode_log(spark, f"{d}/results.txt").first()
    assert e.agent == "lmkb" and e.num_priming_examples == 3 and e.score == 0.5
    g = {r.category: r.p_at_1 for r in fl.read_baseline_counts(spark, f"{d}/glove.txt").collect()}
    assert abs(g["I01"] - 558 / 667) < 1e-12
    assert fl.read_solvable(spark, f"{d}/solvable.txt").first().share == 0.8


def test_prediction_sink_partitions_by_run(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    df = spark.createDataFrame([("TREx", "m", 3, "nl", False, 0, "u1")],
                               "data string, model string, num_examples bigint, priming_type string, "
                               "use_close_examples boolean, random_seed bigint, uuid string")
    fl.write_predictions(df, f"{d}/preds")
    back = spark.read.parquet(f"{d}/preds").filter(F.col("num_examples") == 3)
    assert back.count() == 1 and os.path.isdir(f"{d}/preds/data=TREx/model=m/num_examples=3")


def test_solvable_and_episode_sinks(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    counts = spark.createDataFrame([("I01", 40), ("D02", 0)], "rel string, n_solvable bigint")
    fl.write_solvable(counts, f"{d}/solvable")
    back = {r.category: r.share for r in fl.read_solvable(spark, f"{d}/solvable").collect()}
    assert back == {"I01": 0.8, "D02": 0.0}
    ep = spark.createDataFrame([("lmkb", 0.5)], "agent string, score double")
    fl.append_episode_log(ep, f"{d}/episodes")
    fl.append_episode_log(ep, f"{d}/episodes")
    assert spark.read.parquet(f"{d}/episodes").count() == 2


def test_numbered_lines_over_splits_equal_whole_files(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    for i in range(12):
        _write(f"{d}/small/{i} name.txt", "\n".join(f"{i} line {j}" for j in range(i)) + ("\n" if i % 2 else "\n\n"))
    os.makedirs(f"{d}/big")
    with open(f"{d}/big/a.txt", "wb") as f:
        f.write("".join(f"zeile {j} é\r\n" * (j % 3) + "\n" for j in range(400)).encode() + b"no end")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for path in (f"{d}/small", f"{d}/big"):
            got = sorted(tuple(r) for r in fl.numbered_lines(spark, path).collect())
            want = sorted((r.file_path, r.line_no, r.line) for r in fl.read_lines(spark, path).collect())
            assert got == want
        assert spark.read.text(f"{d}/big").rdd.getNumPartitions() > 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_run_files_with_other_columns_keep_their_names(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    _write(f"{d}/TREx/m/pe-0_nl-nl_ce-False_rs-0.csv", ",uuid,x,y,y_pred,y_pred_prob\n0,u1,a [MASK],p,\"['p']\",[0.5]\n1,u2,b,q,oops,[0.25]\n")
    _write(f"{d}/TREx/m/pe-1_nl-nl_ce-False_rs-0.csv", ",y,cls_embedding,uuid,y_pred,x_primed\n0,\"['v', 'w']\",\"[1, 2]\",u3,\"['w']\",pp\n")
    _write(f"{d}/TREx/m/pe-3_nl-nl_ce-False_rs-0.csv", ",uuid,y\n")
    got = {r.uuid: r for r in fl.read_runs(spark, d).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert got["u1"].y_pred == ["p"] and got["u1"].y_pred_prob == [0.5] and not got["u1"].parse_failed
    assert got["u2"].parse_failed and got["u2"].targets == ["q"]
    u3 = got["u3"]
    assert u3.targets == ["v", "w"] and u3.y_pred == ["w"] and u3.x_primed == "pp" and u3.x is None and u3.num_examples == 1 and not u3.parse_failed


def test_a_run_written_again_replaces_itself(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp")) + "/preds"
    schema = "uuid string, p double, " + fl.RUN_KEY_SCHEMA

    def rows(seed, p):
        return spark.createDataFrame([(f"u{i}", p, "TREx", "m", 3, "nl", False, seed) for i in range(3)], schema)

    fl.write_predictions(rows(0, 0.1).union(rows(1, 0.2)).union(rows(2, 0.3)), d)
    fl.write_predictions(rows(1, 0.9), d)
    back = fl.read_predictions(spark, d, "uuid string, p double")
    assert sorted((r.random_seed, r.p) for r in back.collect()) == [(0, 0.1)] * 3 + [(1, 0.9)] * 3 + [(2, 0.3)] * 3
    assert [f.dataType.simpleString() for f in back.schema.fields][-1] == "bigint"
