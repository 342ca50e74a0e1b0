"""Seeded ranking, splits and resamplers: partition independence and invariants."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from rarefold.functions.seeded import hash_hex
from rarefold.operators import rank, resample, splits
from rarefold.plans import fixtures as fx


def test_dist_rank_equals_global_window_at_any_partitioning(spark):
    v = fx.vec_bin(spark, SF01).withColumn("_h", hash_hex(42, "t", F.col("id")))
    want = {(r.id, r.rk) for r in v.withColumn(
        "rk", F.row_number().over(Window.partitionBy("label").orderBy("_h", "id"))).collect()}
    for n in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = {(r.id, r.rk) for r in rank.dist_rank(v.repartition(n), ["label"], "_h", "id",
                                                    digits=1).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for digits in (2, 4):                       # bucket width does not change the rank
        got = {(r.id, r.rk) for r in rank.dist_rank(v, ["label"], "_h", "id", digits=digits).collect()}
        assert got == want
    spark.conf.set("rarefold.rank.digits", "4")  # the session setting is the default
    try:
        got = {(r.id, r.rk) for r in rank.dist_rank(v, ["label"], "_h", "id").collect()}
        assert got == want
    finally:
        spark.conf.unset("rarefold.rank.digits")


def test_holdout_keeps_class_ratio_and_partitions_ids(spark):
    v = fx.vec_bin(spark, SF01)
    f = splits.stratified_holdout(v, repeats=3).groupBy("repeat", "label", "split").count().collect()
    counts = {(r.repeat, r.label, r.split): r["count"] for r in f}
    for rep in range(3):
        for lab, n in ((0, 441), (1, 59)):
            assert counts[(rep, lab, "test")] == round(0.2 * n)
            assert counts[(rep, lab, "test")] + counts[(rep, lab, "train")] == n


def test_undersample_is_balanced_and_bags_differ(spark):
    v = fx.vec_bin(spark, SF01)
    b = resample.easy_bags(v, 3)
    per = {(r.bag, r.label): r["count"] for r in b.groupBy("bag", "label").count().collect()}
    assert all(per[(bag, 0)] == per[(bag, 1)] == 59 for bag in range(3))
    ids = [set(r.id for r in b.filter((F.col("bag") == i) & (F.col("label") == 0)).collect())
           for i in range(2)]
    assert ids[0] != ids[1]


def test_bootstrap_bags_are_balanced(spark):
    v = fx.vec_bin(spark, SF01)
    b = resample.balanced_bootstrap(v, 4)
    for r in b.groupBy("bag").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect():
        assert r.n == 2 * r.p


def test_weighted_draw_counts_and_range(spark):
    t = fx.text_bin(spark, SF01).select("id", "label")
    d = resample.weighted_draw(t)
    assert d.count() == t.count()
    assert d.select("draw").distinct().count() == t.count()
    frac = d.agg(F.avg("label")).first()[0]
    assert 0.35 < frac < 0.65          # classes drawn about equally often


def test_logo_fold_stats_partition(spark):
    t = fx.text_bin(spark, SF01).drop("text")
    s = splits.logo_fold_stats(splits.logo_assign(t)).collect()
    n = t.count()
    assert len(s) == 20
    assert all(r.n_train + r.n_test == n for r in s)
    assert sum(r.n_test for r in s) == n
    assert any(r.pos_test == 0 for r in s)   # groups without positives exist


def test_redivision_keeps_sizes_and_moves_wrong_rows_first(spark):
    from rarefold.operators import ensembles
    v = fx.vec_bin(spark, SF01)
    h = splits.random_halves(v)
    state = h.select("id", F.when(F.col("split") == "train", "train").otherwise("valid").alias("side"))
    n_train = state.filter("side = 'train'").count()
    # mark every third valid row as misclassified
    correct = h.filter("split = 'valid'").select("id", (F.col("id") % 3 != 0).alias("correct"))
    new = ensembles.redivide(state, correct, n_train, 0)
    assert new.filter("side = 'train'").count() == n_train
    assert new.count() == v.count()
    moved = {r.id for r in correct.filter(~F.col("correct")).collect()}
    got = {r.id for r in new.filter("side = 'train'").collect()}
    assert moved <= got


def test_arrow_token_map_equals_the_column_form(spark):
    from rarefold.functions import tokens as TK
    df = spark.createDataFrame([(1, "A b, c-d é1 _x"), (2, ""), (3, None), (4, " .. ")], "id long, text string")
    got = {r.id: list(r.token_ids) for r in TK.arrow_token_map(df, vocab=64).collect()}
    want = {r.id: list(r.t or []) for r in df.select("id", TK.token_ids(F.col("text"), 64).alias("t")).collect()}
    assert got == want


def test_leave_one_group_out_round_trip(spark, tmpdir_path):
    from rarefold.operators import splits
    from rarefold.sources import files
    rows = spark.createDataFrame([(i, f"g{i % 3}", i % 2) for i in range(12)], "id long, grp string, label int")
    path = f"{tmpdir_path}/logo"
    splits.logo_assign(rows).write.partitionBy("fold").parquet(path)
    for fold in range(3):
        train, test = files.load_logo_fold(spark, path, fold)
        assert {r.id for r in test.collect()} == {i for i in range(12) if i % 3 == fold}
        assert {r.id for r in train.collect()} == {i for i in range(12) if i % 3 != fold}
