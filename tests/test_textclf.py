"""The four text classifier variants on planted vectors, and their step in NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarefold.operators import resample, textclf


def _rows(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 5 == 0).astype(int)
    X = np.abs(rng.normal(size=(n, 4)))
    X[:, 1] += 2.0 * y
    return spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(n)],
                                 "id long, features array<double>, label int"), X, y


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("variant", ["plain", "bs", "wce", "bs_wce"])
def test_variants_learn_and_keep_the_best_epoch(spark, variant):
    df, X, y = _rows(spark)
    model = textclf.fit(df, df, variant=variant, epochs=6)
    assert len(model.history) == 6
    losses = [h["eval_loss"] for h in model.history]
    assert model.best_epoch == int(np.argmin(losses)) and min(losses) < np.log(2)
    out = textclf.predict(df, model).collect()
    assert all(0 <= r.proba <= 1 for r in out)
    up = np.mean([r.proba for r in out if r.label]) - np.mean([r.proba for r in out if not r.label])
    assert up > 0.05
    hist = spark.createDataFrame([(h["epoch"], h["eval_loss"]) for h in model.history], "epoch int, eval_loss double")
    assert textclf.select_best(hist).first().best_epoch == model.best_epoch


@pytest.mark.parametrize("variant", ["plain", "wce", "bs"])
def test_first_step_equals_numpy(spark, variant):
    df, X, y = _rows(spark, 40, seed=2)
    model = textclf.fit(df, df, variant=variant, epochs=1, lr=0.5)
    rows = np.arange(len(y))
    if variant == "bs":
        rows = np.array([r.id for r in resample.weighted_draws(df.select("id", "label"), [0]).collect()])
        assert len(rows) == len(y)
    A, t = np.hstack([X, np.ones((len(y), 1))])[rows], y[rows]
    counts = np.bincount(y)
    w = np.ones(2)
    if variant == "wce":
        from rarefold.operators import weights
        cw = {r["label"]: r["weight_norm"] for r in weights.class_weights(df).collect()}
        w = np.array([cw[0], cw[1]])
        assert w[1] > w[0] and counts[1] < counts[0]
    P = _softmax(A @ np.zeros((5, 2)))
    G = P.copy()
    G[np.arange(len(t)), t] -= 1
    grad = (G * w[t][:, None]).T @ A / w[t].sum()
    assert np.allclose(model.W, -0.5 * grad, atol=1e-12)


def test_balanced_draws_take_both_classes_alike(spark):
    df, _, y = _rows(spark, 400, seed=4)
    d = resample.weighted_draws(df.select("id", "label"), range(3))
    for r in d.groupBy("epoch").agg(F.count("*").alias("n"), F.avg("label").alias("p")).collect():
        assert r.n == 400 and abs(r.p - 0.5) < 0.1


def _numpy_sgd(X, y, ids, orders, cw, lr, batch):
    A, W = np.hstack([X, np.ones((len(y), 1))]), np.zeros((2, X.shape[1] + 1))
    for epoch, order in enumerate(orders):
        for s in range(0, len(order), batch):
            i = order[s:s + batch]
            P = _softmax(A[i] @ W.T)
            P[np.arange(len(i)), y[i]] -= 1
            w = cw[y[i]] / cw[y[i]].sum()
            W = W - lr * (1 - epoch / len(orders)) * (P * w[:, None]).T @ A[i]
    return W


def _order(n, epoch, seed=42):
    import hashlib
    return np.array(sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:sgd:0:{epoch}:{i}:0".encode()).digest()))


def test_batch_steps_equal_numpy(spark):
    df, X, y = _rows(spark, 50, seed=5)
    model = textclf.fit(df, df, variant="wce", epochs=3, lr=0.5, batch_size=16)
    cw = 1 / np.bincount(y)
    W = [_numpy_sgd(X, y, None, [_order(50, e) for e in range(3)][:k], cw / cw.sum(), 0.5, 16) for k in (3,)]
    if model.best_epoch == 2:
        assert np.allclose(model.W, W[0], atol=1e-12)
    assert [h["steps"] for h in model.history] == [4, 4, 4]


def test_steps_grow_with_the_table(spark):
    steps = []
    for n in (64, 256):
        df, _, _ = _rows(spark, n)
        steps.append(sum(h["steps"] for h in textclf.fit(df, df, epochs=2, lr=0.5, batch_size=16).history))
    assert steps == [8, 32]


@pytest.mark.parametrize("variant", ["plain", "bs_wce"])
def test_shards_agree_with_one_shard(spark, variant):
    """One step over all rows does not depend on the shards; batch steps averaged over shards learn alike."""
    df, X, y = _rows(spark, 400, seed=6)
    one, many = (textclf.fit(df, df, variant=variant, epochs=1, lr=0.5, shard_rows=n) for n in (4096, 30))
    assert np.allclose(one.W, many.W, atol=1e-12)
    a, b = (textclf.fit(df, df, variant=variant, epochs=10, lr=0.5, batch_size=16, shard_rows=n) for n in (4096, 100))
    la, lb = (min(h["eval_loss"] for h in m.history) for m in (a, b))
    full = min(h["eval_loss"] for h in textclf.fit(df, df, variant=variant, epochs=10, lr=0.5).history)
    assert la < full and lb < full and abs(la - lb) < 0.15         # better than ten steps over all rows


def test_text_folds(spark):
    """Folds as members: vectors, roles and models equal those of one fold at a time."""
    from rarefold.operators import splits, textfeat
    words = ["alpha", "beta", "gamma", "delta", "bad", "worse"]
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(words[:4] if i % 4 else words[2:], 8)) if i else "", int(i % 4 == 0)) for i in range(80)]
    texts = spark.createDataFrame(rows, "id long, text string, label int")
    sides = splits.stratified_holdout(texts.select("id", "label"), repeats=3)
    folds = textclf.text_folds(texts, sides, 32, epochs=2)
    models = folds.fit("wce", 2)
    pred = {(r.repeat, r.id): (r.proba, r.pred) for r in folds.predict(models).collect()}
    assert set(pred) == {(r.repeat, r.id) for r in sides.where("split = 'test'").collect()}
    for k in range(3):
        own = sides.where(F.col("repeat") == k)
        vec = textfeat.to_dense(textfeat.vectorise(own.where("split = 'train'"), texts, 32), 32)
        dense = own.join(vec, "id", "left").withColumn("features", F.coalesce("features", F.array_repeat(F.lit(0.0), 32)))
        roles = splits.inner_holdout(own.where("split = 'train'").select("repeat", "id", "label")).select("id", "held_out")
        tr = dense.join(roles, "id")
        one = textclf.fit(tr.where("NOT held_out"), tr.where("held_out"), "wce", 1, lr=0.5)
        assert np.allclose(one.W, folds.fit("wce", 1, lr=0.5, batch_size=None)[k].W, atol=1e-9)
        some = textclf.text_folds(texts, own, 32, epochs=2)
        assert some.repeats == [k]
        for r in textclf.predict(dense.where("split = 'test'"), models[k]).collect():
            assert pred[(k, r.id)] == (pytest.approx(r.proba), r.pred)
    bal = textclf.text_folds(texts, sides, 32, epochs=2, balanced=True)
    assert all(sum(h["steps"] for h in m.history) > 0 for m in bal.fit("bs", 2))
    test = textclf.text_folds(texts, sides, 32, epochs=2, select_on="test")
    assert all(m.history[0]["eval_loss"] > 0 for m in test.fit("plain", 2))


def test_fold_vectors_sort_no_row_per_fold_and_term(spark):
    """A document's terms stay one row in every fold; a repeated id counts twice in its norm."""
    from rarefold.operators import textfeat
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "c c d")], "id long, text string")
    folds = spark.createDataFrame([(r, i, "test" if i == r + 1 else "train") for r in range(2) for i in (1, 2, 3)] + [(0, 3, "train")],
                                  "repeat int, id long, split string")
    out = textfeat.vectorise_folds(docs, folds, 64)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    norms = {}
    for r in out.collect():
        norms[(r.repeat, r.id)] = norms.get((r.repeat, r.id), 0.0) + r.weight ** 2
    assert set(norms) == {(r, i) for r in range(2) for i in (1, 2, 3)} and all(abs(v - 1) < 1e-12 for v in norms.values())
    assert out.where("repeat = 0 and id = 3").count() == 4


def test_document_vectors_sort_no_row_per_term(spark):
    """A document is one row up to its weights; the rows of a repeated id are one document."""
    from rarefold.operators import textfeat
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (2, "c"), (3, None), (4, "..."), (None, "a"), (None, "a b")], "id long, text string")
    train = docs.where("id < 3").select("id")
    out = textfeat.vectorise(train, docs, 1 << 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append(r.weight)
    idf = {w: np.log(4 / (1 + d)) + 1 for w, d in (("a", 1), ("b", 2), ("c", 1))}
    for i, want in ((1, {"a": 1, "b": 2}), (2, {"b": 1, "c": 2}), (None, {"a": 2, "b": 1})):
        w = np.array([n * idf[t] for t, n in want.items()])
        assert np.allclose(sorted(got.pop(i)), sorted(w / np.sqrt((w * w).sum())))
    assert not got
    for most in (1, 1 << 19):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(textfeat, "TAKEN", most)
            counts = {r.id: list(zip(r.terms, r.counts)) for r in textfeat.term_lists(docs.where("id = 1 or id > 2"), 8).collect()}
        assert {i: sum(n for _, n in c) for i, c in counts.items()} == {1: 3, 3: 0, 4: 0} and counts[1] == sorted(counts[1])


def test_fold_frequencies_add_up_inside_tasks(spark):
    from rarefold.operators import textfeat
    rows = spark.createDataFrame([([0, 1], [1, 2]), ([1, 1], [2]), ([], [3]), ([2], [])], "_folds array<int>, terms array<int>").repartition(3)
    out = textfeat.fold_frequencies(rows, 8, "fold")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.fold, r.term): r._df for r in out.collect()} == {(0, 1): 1, (0, 2): 1, (1, 1): 1, (1, 2): 3}


def test_shards_are_small_and_spread_over_files(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2).cast("int").alias("label"), F.expr("array(1, 700)").alias("terms"),
                                    F.expr("array(2D, 1D)").alias("weights"), F.expr("array(0, 1)").alias("roles"))
    table = textclf.shards(textclf._with_empty(rows), 250)
    per = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert sum(per) == 16 and max(per) <= 3
    for r in table.collect():
        assert len(r.weights) < 2 * r.n + 200 and len(r.terms) < 4 * r.n + 200
        s = textclf._Shard(r.asDict(), 2)
        assert s.n == len(s.ids) and s.terms.tolist() == [1, 700] * s.n and s.weights.tolist() == [2.0, 1.0] * s.n


@pytest.mark.parametrize("batch", [16, None])
def test_dense_runs_take_the_same_steps(spark, batch, monkeypatch):
    df, _, _ = _rows(spark, 90, seed=8)
    rows = textclf._with_empty(df.select("id", "label", F.sequence(F.lit(0), F.lit(3)).alias("terms"), F.col("features").alias("weights"),
                                         F.array(F.lit(0)).alias("roles")))
    s = textclf._Shard(textclf.shards(rows).first().asDict(), 1)
    got = []
    for most in (1, 5 * 20, 1 << 19):
        monkeypatch.setattr(textclf, "DENSE", most)
        got.append(s.steps(np.arange(90), None, np.zeros((2, 5)), np.array([0.2, 0.8]), 0.5, batch))
    assert all(n == (6 if batch else 1) and np.allclose(W, got[0][0], atol=1e-12) for W, n in got)


def test_rows_as_stored_equal_scaled_vectors(spark, monkeypatch):
    """Steps and scores on stored counts, with the model scaled, equal those on the vectors, with and without the block."""
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 4, (70, 6))
    counts[3] = 0
    y, idf, W = rng.integers(0, 2, 70), np.array([1.5, 2.0, 0.0, 1.0, 3.0, 1.2]), rng.normal(size=(2, 7))
    rows = spark.createDataFrame([(i, int(y[i]), [int(t) for t in np.flatnonzero(counts[i])], [float(c) for c in counts[i][counts[i] > 0]], [0])
                                  for i in range(70)], "id long, label int, terms array<int>, weights array<double>, roles array<int>")
    r = textclf.shards(textclf._with_empty(rows)).first().asDict()
    X = counts * idf
    X = np.hstack([X / np.maximum(np.sqrt((X * X).sum(axis=1, keepdims=True)), 1e-300), np.ones((70, 1))])
    want = W.copy()
    for s in range(0, 70, 16):
        P = _softmax(X[s:s + 16] @ want.T)
        P[np.arange(len(P)), y[s:s + 16]] -= 1
        w = np.array([0.3, 0.7])[y[s:s + 16]]
        want = want - 0.5 * (P * w[:, None] / w.sum()).T @ X[s:s + 16]
    for block in (0, 1 << 25):
        monkeypatch.setattr(textclf, "BLOCK", block)
        s = textclf._Shard(r, 1)
        got, n = s.steps(np.arange(70), idf, W, np.array([0.3, 0.7]), 0.5, 16)
        assert n == 5 and np.allclose(got, want, atol=1e-12) and (got[:, 2] == W[:, 2]).all()
        assert np.allclose(s.scores(np.arange(70), idf, W), X @ W.T, atol=1e-12)
        assert (s.block is None) == (not block) and (block == 0 or s.block.dtype.itemsize == 1)


def test_a_file_holds_one_shard(spark):
    rows = spark.range(4000).select("id", F.lit(1).alias("label"), F.expr("array(1)").alias("terms"), F.expr("array(2D)").alias("weights"),
                                    F.expr("array(0)").alias("roles"))
    per = textclf.shards(textclf._with_empty(rows), 50).groupBy(F.input_file_name()).count().collect()
    assert len(per) == 80 and {r["count"] for r in per} == {1}


def test_workers_take_few_bytes_at_a_time(spark):
    """What a worker holds does not grow with the rows of its task."""
    from rarefold.operators import textfeat
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(0, 9000, 1, 1).select("id", F.expr("repeat('word other ', 300)").alias("text"))
    textfeat.term_lists(docs, 64)
    most = docs.mapInArrow(lambda bs: (b.select(["id"]).slice(0, 1).set_column(0, "id", pa.array([b.nbytes], pa.int64())) for b in bs), "id long").agg(F.max("id")).first()[0]
    assert most < 6 << 20
    for own, left in (("1m", "1m"), ("16m", f"{4 << 20}b")):
        spark.conf.set(name, own)
        textfeat.term_lists(docs, 64)
        assert spark.conf.get(name) == left
    spark.conf.unset(name)


def test_draw_owners_are_not_ranked(spark):
    """Only the rows that are drawn need a rank; rows without a class neither draw nor are drawn."""
    df = spark.createDataFrame([(m, i, None if i == 5 else i % 3 // 2) for m in (0, 1) for i in range(30)] + [(None, 99, 1)],
                               "repeat int, id long, label int")
    d = resample.weighted_draws(df, range(4), member_cols=["repeat"])
    got = d.collect()
    assert len(got) == 2 * 29 * 4 and {r.id for r in got} <= {i for i in range(30) if i != 5} and {r.draw for r in got} == {i for i in range(30) if i != 5}
    own = d.select("draw", "epoch")._jdf.queryExecution().optimizedPlan().toString()
    assert own.count("row_number() windowspecdefinition") == 5      # the drawn rows, and twice their classes; 6 with the owners
