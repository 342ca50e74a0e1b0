"""File scans and sinks: paired lines, fold JSON, ledger resume."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rarefold.operators import ledger
from rarefold.sources import files


def test_paired_files_and_mismatch(spark, tmpdir_path):
    s, l = os.path.join(tmpdir_path, "Sentences"), os.path.join(tmpdir_path, "Labels")
    os.makedirs(s), os.makedirs(l)
    open(os.path.join(s, "a.txt"), "w").write("  first line \r\nsecond \n\nfourth\n")
    open(os.path.join(l, "a.txt"), "w").write("1\n0\n 1 \n-1\n")
    rows = sorted(files.read_paired_files(spark, s, l).collect(), key=lambda r: r.line_no)
    assert [r.text for r in rows] == ["first line", "second", "", "fourth"]
    assert [r.label for r in rows] == [1, 0, 1, 0]
    open(os.path.join(l, "a.txt"), "w").write("1\n0\n")
    with pytest.raises(Exception):
        files.read_paired_files(spark, s, l).collect()


def test_fold_json_roundtrip(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "train.json")
    json.dump({"text": ["x y", "z"], "labels": [0, 1]}, open(p, "w"))
    rows = sorted(files.read_fold_json(spark, p).collect(), key=lambda r: r.pos)
    assert [(r.text, r.label) for r in rows] == [("x y", 0), ("z", 1)]


def test_ledger_append_is_idempotent_and_resumes(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "ledger")
    assert ledger.read(spark, path).count() == 0
    scores = spark.createDataFrame([("r", 0, "f1", 0.5), ("r", 1, "f1", 0.7)],
                                   "run string, test_number int, metric string, value double")
    ledger.append(scores, path)
    ledger.append(scores.filter("test_number = 1").withColumn("value", F.lit(0.9)), path)
    got = {(r.test_number, r.value) for r in ledger.read(spark, path).collect()}
    assert got == {(0, 0.5), (1, 0.9)}
    runs = spark.createDataFrame([("r", 3)], "run string, n_folds int")
    todo = ledger.pending(ledger.run_grid(runs), ledger.read(spark, path)).collect()
    assert [r.test_number for r in todo] == [2]
    fin = ledger.finished_runs(ledger.read(spark, path), runs).first()
    assert fin.finished is False and fin.max_fold == 1


def test_release_deletes_only_materialized_tables(spark):
    from rarefold.session import materialize, release, spread
    df = spark.range(10).withColumnRenamed("id", "k")
    m = materialize(df, "release-test")
    path = m._rarefold_path
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    assert m.count() == 10 and fs.exists(p)
    release(m, df)                    # a frame that was never written is ignored
    assert not fs.exists(p)
    release(m)                        # releasing twice is harmless
    assert spread(df, "k").count() == 10


def test_files_of_many_splits_pair_by_line(spark, tmp_path):
    """Lines are numbered through all splits of a file, whatever breaks it uses."""
    import random
    rnd = random.Random(3)
    want = {}
    for d in ("Sentences", "Labels"):
        (tmp_path / d).mkdir()
    for k, brk in enumerate(["\n", "\r\n", "\r", "\n"]):
        texts = ["" if i % 17 == 5 else " ".join(rnd.choice(["x", "yy", "é"]) for _ in range(rnd.randrange(1, 9))) for i in range(400)]
        labels = [rnd.choice(["1", "-1", " 1 ", "0"]) for _ in texts]
        end = brk if k != 3 else ""
        (tmp_path / "Sentences" / f"f{k}.txt").write_bytes((brk.join(texts) + (end or "")).encode())
        (tmp_path / "Labels" / f"f{k}.txt").write_bytes((brk.join(labels) + end).encode())
        own = (tmp_path / "Sentences" / f"f{k}.txt").open(encoding="utf-8").read().split("\n")
        for i, (t, y) in enumerate(zip(texts, labels)):
            want[(f"f{k}.txt", i)] = (t.strip(), int(y.strip() == "1"))
        assert own[:3] == texts[:3]
    (tmp_path / "Sentences" / "empty.txt").write_bytes(b"")
    (tmp_path / "Labels" / "empty.txt").write_bytes(b"")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert spark.read.text(str(tmp_path / "Sentences")).rdd.getNumPartitions() > 12
        got = files.read_paired_files(spark, str(tmp_path / "Sentences"), str(tmp_path / "Labels")).collect()
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert {(r.file, r.line_no): (r.text, r.label) for r in got} == want and len(got) == len(want)


def test_unequal_line_counts_stop_the_job(spark, tmp_path):
    for d, text in (("s", "a\nb\nc\n"), ("l", "1\n0\n")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.txt").write_text(text)
    with pytest.raises(Exception, match="line counts differ"):
        files.read_paired_files(spark, str(tmp_path / "s"), str(tmp_path / "l")).collect()
    assert files.read_paired_files(spark, str(tmp_path / "s"), str(tmp_path / "l"), strict=False).count() == 3


def test_fold_export_ranks_no_texts(spark, monkeypatch):
    from rarefold.operators import splits
    from rarefold.plans import catalog  # noqa: F401  (registers all)
    from rarefold.plans import catalog_prep
    seen, ranked = [], splits.stratified_holdout
    monkeypatch.setattr(splits, "stratified_holdout", lambda d, **kw: seen.append(d.columns) or ranked(d, **kw))
    out = catalog_prep.a4_fold_json_scan(spark, "/root/testdata/sf0.001")
    assert "text" not in seen[0] and out.count() == 20


def test_a_text_is_split_once_not_for_each_line(spark):
    df = spark.createDataFrame([("a", "x\ny\r\n\rz\n"), ("b", ""), ("c", None), ("d", "\n"), ("e", "p")], "file string, value string")
    out = files.lines(df)
    above = out._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "split(" not in above
    assert sorted(map(tuple, out.collect())) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, ""), ("a", 3, "z"), ("d", 0, ""), ("e", 0, "p")]


def test_fold_json_deals_each_text_once(spark, tmp_path):
    """Ten folds of the same texts: no shuffle and no sort carries a text once per fold, and the files are compressed."""
    import os
    from pyspark.sql import functions as F
    rows = spark.range(60).selectExpr("id as k", "id % 20 as id", "concat('text ', id, repeat(' abc', 50)) as text", "cast(id % 3 = 0 as int) as label")
    sides = spark.range(600).selectExpr("id % 60 as k", "cast(id div 60 as int) as fold", "if((id * 7) % 5 = 0, 'test', 'train') as split")
    seen, write = [], files.row_join
    files.row_join = lambda a, b, on: seen.append((a.count(), b.count())) or write(a, b, on)
    try:
        files.write_fold_json(rows, sides, str(tmp_path / "j"), "k", chunk_rows=7)
    finally:
        files.row_join = write
    assert seen == [(60, 60)]                                # texts meet their fold lists, once each
    names = [n for _, _, own in os.walk(tmp_path / "j") for n in own if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    back = files.read_fold_json(spark, str(tmp_path / "j"), multi_line=False)
    back = back.withColumn("fold", F.regexp_extract("path", "fold=([0-9]+)", 1).cast("int")).withColumn("split", F.regexp_extract("path", "split=([a-z]+)", 1))
    want = sides.join(rows, "k").select("fold", "split", "text", "label")
    assert sorted(map(tuple, back.select("fold", "split", "text", "label").collect())) == sorted(map(tuple, want.collect()))
    assert back.agg(F.max("pos")).first()[0] < 40 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    empty = files.write_fold_json(rows.where("false"), sides.where("false"), str(tmp_path / "e"), "k")
    assert empty is None
