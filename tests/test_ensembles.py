"""The ensembles on a planted unbalanced set, and real boosting against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators import ensembles, lmnn, resample, stumps


def _planted(spark, n=160, seed=0):
    """One positive in six, shifted along one axis; the other axis is noise."""
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 6 == 0).astype(int)
    X = rng.normal(size=(n, 3))
    X[:, 0] += 3.0 * y
    X[:, 2] *= 3.0
    return spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(n)],
                                 "id long, features array<double>, label int"), X, y


def _gmean(rows):
    tp = [r.pred for r in rows if r.label == 1]
    tn = [1 - r.pred for r in rows if r.label == 0]
    return float(np.sqrt(np.mean(tp) * np.mean(tn)))


def _check(rows, n, least=0.8):
    assert len(rows) == n and all(0.0 <= r.proba <= 1.0 and r.pred in (0, 1) for r in rows)
    assert _gmean(rows) >= least                     # the majority class alone has 0


def test_easy_ensemble(spark):
    df, _, y = _planted(spark)
    models = ensembles.easy_ensemble_fit(df, n_bags=4, n_rounds=10)
    assert len(models) == 4 and all(len(m.stumps) >= 1 for m in models.values())
    _check(ensembles.predict_mean(df, models).collect(), len(y))


def test_rusboost_keeps_every_round(spark):
    df, _, y = _planted(spark)
    models = ensembles.rusboost_fit(df, n_rounds=50)
    assert len(models["0"].stumps) == 50
    _check(ensembles.predict_mean(df, models).collect(), len(y))


def test_rusboost_equals_numpy(spark):
    df, X, y = _planted(spark, 60, seed=3)
    model = ensembles.rusboost_fit(df, n_rounds=6)["0"]
    draws = {(r.round, r.id) for r in resample.rus_rounds(df.select("id", "label"), 6).collect()}
    w = np.ones(len(y))
    lo, hi = X.min(axis=0), X.max(axis=0)
    B = np.clip(np.floor((X - lo) / ((hi - lo) / stumps.N_BINS)), 0, stumps.N_BINS - 1).astype(int)
    total = np.zeros(len(y))
    for r, st in enumerate(model.stumps):
        use = np.array([(r, i) in draws for i in range(len(y))])
        h = np.zeros((2, 3, stumps.N_BINS))
        for i in np.flatnonzero(use):
            for f in range(3):
                h[y[i], f, B[i, f]] += w[i]
        f, b, pl, pr, _ = stumps.best_split_np(h[0], h[1])
        assert (f, b) == (st.feature, st.bin) and abs(pl - st.p_left) < 1e-9 and abs(pr - st.p_right) < 1e-9
        odds = stumps.leaf_log_odds(np.where(B[:, f] <= b, pl, pr))
        total += odds
        w = w * np.exp(-0.5 * (2 * y - 1) * odds)
        w /= w.sum()
    got = {r.id: r.proba for r in ensembles.predict_mean(df, {"0": model}).collect()}
    want = 1 / (1 + np.exp(-total / len(model.stumps)))
    assert np.allclose([got[i] for i in range(len(y))], want)


def test_metric_boosting_has_a_map_per_round(spark):
    df, _, y = _planted(spark, 90)
    models = ensembles.mlboosting_fit(df, n_rounds=8)
    m = models["0"]
    assert len(m.stumps) == 8 and len({id(x) for x in m.maps}) == 8 and all(x.shape == (3, 3) for x in m.maps)
    _check(ensembles.predict_mean(df, models).collect(), len(y))


def test_metric_bagging(spark):
    df, _, y = _planted(spark, 90)
    model = ensembles.mlbagging_fit(df, n_bags=3)
    out = ensembles.mlbagging_predict(df, model).join(df.select(F.col("id").alias("qid"), "label"), "qid")
    _check(out.collect(), len(y))


def test_metric_stacking(spark):
    df, _, y = _planted(spark, 90)
    model = ensembles.mlstacking_fit(df, n_estimators=2, n_folds=3, n_rounds=5)
    assert set(model.models) == {f"{e}:{f}" for e in range(2) for f in ("0", "1", "2", "all")}
    _check(ensembles.mlstacking_predict(df, model).collect(), len(y))


@pytest.mark.parametrize("promote", ["wrong", "correct"])
def test_metric_boost_stacking(spark, promote):
    df, _, y = _planted(spark, 90)
    model = ensembles.mlboostacking_fit(df, max_iteration=2, n_bags=2, n_rounds=5, promote=promote)
    assert model.stacked.shape == (6, 3) and len(model.iterations) == 2
    _check(ensembles.mlboostacking_predict(df, model).collect(), len(y))


def test_lmnn_stops_by_tolerance_at_the_map_numpy_finds(spark):
    df, X, y = _planted(spark, 100)
    model = lmnn.fit(df, k=3)
    hist = [h for h in model.history if h["accepted"]]
    assert 10 <= len(model.history) < 1000           # by tolerance, not by the guard
    assert all(a["loss"] >= b["loss"] for a, b in zip(hist, hist[1:]))
    # the objective of the fitted map, from scratch
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    same = y[:, None] == y[None]
    L = model.maps["0"]
    Z = X @ L.T
    DZ = ((Z[:, None] - Z[None]) ** 2).sum(-1)
    pull = push = pairs = 0.0
    for i in range(len(y)):
        near = sorted((j for j in range(len(y)) if same[i, j] and j != i), key=lambda j: (D[i, j], j))[:3]
        for j in near:
            pairs += 1
            pull += DZ[i, j]
            push += np.maximum(0, 1 + DZ[i, j] - DZ[i, ~same[i]]).sum()
    assert abs((0.5 * pull + 0.5 * push) / pairs - hist[-1]["loss"]) < 1e-6


def test_undersample_strategies(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "id long, label int")
    count = lambda d: {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    assert count(resample.undersample(df)) == {0: 10, 1: 10}
    assert count(resample.undersample(df, strategy=0.5)) == {0: 20, 1: 10}
    assert count(resample.undersample(df, strategy={0: 33})) == {0: 33, 1: 10}


def _numpy_lmnn(X, y, iterations, lr=0.1, k=3, mu=0.5):
    """Plain LMNN descent: the same step rule, all triplets, no blocks."""
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    near = [sorted((j for j in range(len(y)) if y[i] == y[j] and j != i), key=lambda j: (D[i, j], j))[:k] for i in range(len(y))]
    pairs = sum(map(len, near))

    def terms(L):
        Z = X @ L.T
        f, G = 0.0, np.zeros((X.shape[1],) * 2)
        for i in range(len(y)):
            for j in near[i]:
                dij = ((Z[i] - Z[j]) ** 2).sum()
                C = np.outer(X[i] - X[j], X[i] - X[j])
                f += (1 - mu) * dij
                G += (1 - mu) * C
                for l in np.flatnonzero(y != y[i]):
                    h = 1 + dij - ((Z[i] - Z[l]) ** 2).sum()
                    if h > 0:
                        f += mu * h
                        G += mu * (C - np.outer(X[i] - X[l], X[i] - X[l]))
        return f / pairs, G / pairs

    L, best = np.eye(X.shape[1]), None
    for _ in range(iterations):
        f, G = terms(L)
        if best is None or f <= best[0]:
            lr *= 1.2 if best else 1.0
            best = (f, L.copy(), G)
        else:
            lr /= 2.0
        L = best[1] - lr * 2.0 * best[1] @ best[2]
    return best[1], best[0]


@pytest.mark.parametrize("block_rows", [2048, 9])
def test_lmnn_map_equals_numpy(spark, block_rows):
    df, X, y = _planted(spark, 100)
    model = lmnn.fit(df, max_iter=25, min_iter=25, tol=0.0, block_rows=block_rows)
    L, f = _numpy_lmnn(X, y, 25)
    assert np.allclose(model.maps["0"], L, atol=1e-8)
    assert abs([h for h in model.history if h["accepted"]][-1]["loss"] - f) < 1e-9


def _clusters(spark, n, seed=5, spread=30.0):
    """Two classes in clusters far apart: most block pairs hold no impostor."""
    rng = np.random.default_rng(seed)
    c = rng.normal(scale=spread, size=(n // 20, 3))
    which = rng.integers(0, len(c), n)
    X, y = c[which] + rng.normal(scale=0.3, size=(n, 3)), (which % 2).astype(int)
    return spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(n)],
                                 "id long, features array<double>, label int"), X, y


def test_lmnn_leaves_out_pairs_without_impostors(spark):
    df, X, y = _clusters(spark, 400)
    blocks = lmnn.prepare(df, 3, None, 20)
    every = {(m, c, b) for m, c, b, _ in blocks.names}
    pairs = lmnn.active_pairs(blocks, {"0": np.eye(3)})
    assert len(every) >= 16 and len(pairs) < 0.3 * len(every) ** 2 / 2
    got = {r.id: (r.n_impostors, r.n_active) for r in lmnn.impostor_counts(df, block_rows=20).collect()}
    assert got == {r.id: (r.n_impostors, r.n_active) for r in lmnn.impostor_counts(df).collect()} and len(got) == 400
    a, b = (lmnn.fit(df, max_iter=12, min_iter=12, tol=0.0, block_rows=n) for n in (20, 2048))
    assert np.allclose(a.maps["0"], b.maps["0"], atol=1e-8)
    assert lmnn.loss_terms(df, block_rows=20) == pytest.approx(lmnn.loss_terms(df))


def test_lmnn_room_covers_nearby_maps(spark):
    """Pairs taken at one map hold all impostors of a map within ``ROOM`` of it."""
    df, X, y = _clusters(spark, 300, seed=6, spread=4.0)
    blocks = lmnn.prepare(df, 3, None, 15)
    rng = np.random.default_rng(1)
    L0 = np.eye(3) + 0.1 * rng.normal(size=(3, 3))
    L1 = L0 @ (np.eye(3) + 0.05 * rng.normal(size=(3, 3)))
    assert not lmnn._moved(L1, L0) and lmnn._moved(1.3 * L0, L0) and lmnn._moved(L0 / 1.3, L0)
    near = set(lmnn.active_pairs(blocks, {"0": L0}))
    place = {int(i): (r._m, r._cls, r._b) for r in blocks.table.collect() for i in np.frombuffer(r.ids, np.int64)}
    D, Z = (((A[:, None] - A[None]) ** 2).sum(-1) for A in (X, X @ L1.T))
    found = 0
    for i in range(len(y)):
        own = sorted((j for j in range(len(y)) if y[j] == y[i] and j != i), key=lambda j: (D[i, j], j))[:3]
        for l in np.flatnonzero((y != y[i]) & (Z[i] < 1 + max(Z[i, j] for j in own))):
            assert (*place[i], *place[int(l)][1:]) in near
            found += 1
    assert found and len(near) < sum(c != c2 for _, c, _, _ in blocks.names for _, c2, _, _ in blocks.names)


def test_lmnn_writes_bytes_linear_in_rows(spark, monkeypatch):
    """Blocks of n and 4n rows: four times the bytes, not sixteen."""
    sizes = {}
    for n in (300, 1200):
        blocks = lmnn.prepare(_planted(spark, n)[0], 3, None, 25)
        sizes[n] = sum(len(r.xi) + len(r.xt) + len(r.tm) + len(r.ids) for r in blocks.table.collect())
        assert sum(x[-1] for x in blocks.names) == n and len(blocks.names) >= n // 25
    assert sizes[1200] == 4 * sizes[300]
    # beyond KEEP the tiles are not kept either
    monkeypatch.setattr(lmnn, "KEEP", 0)
    tiles = lmnn._tiles(blocks, lmnn.active_pairs(blocks, {"0": np.eye(3)}))
    assert not tiles.is_cached


def test_a_small_step_is_not_convergence():
    s = lmnn._Steps()
    assert not s.done(0.1, 0.5, 1e-3) and not s.done(0.01, 1e-5, 1e-3) and not s.done(0.012, 1e-5, 1e-3)
    assert not s.done(0.1, 1e-5, 1e-3) and s.done(0.1, 1e-5, 1e-3)


def test_carried_margins_give_the_same_stumps(spark):
    df, X, y = _planted(spark, 120, seed=8)
    for real in (False, True):
        a, b = (stumps.fit_boost(df, 13, real=real, refresh=n)["0"] for n in (100, 3))
        assert [(s.feature, s.bin) for s in a.stumps] == [(s.feature, s.bin) for s in b.stumps]
        assert np.allclose(a.alphas, b.alphas) and np.allclose([s.p_left for s in a.stumps], [s.p_left for s in b.stumps])
        assert a.norm == pytest.approx(b.norm)


def test_a_round_scores_only_recent_stumps(spark, monkeypatch):
    """The work of a round does not grow with its number."""
    seen, plain = [], stumps.histogram_vectors

    def counted(df, models, *a, **k):
        seen.append(max(len(m.stumps) for m in models.values()))
        return plain(df, models, *a, **k)

    monkeypatch.setattr(stumps, "histogram_vectors", counted)
    df, _, _ = _planted(spark, 60)
    stumps.fit_boost(df, 12, real=True, refresh=4)
    assert seen == [0, 1, 2, 3] * 3


@pytest.mark.parametrize("metric", [False, True])
def test_boosted_folds_are_members(spark, metric):
    from rarefold.operators import splits
    df, X, y = _planted(spark, 120)
    sides = splits.stratified_holdout(df.select("id", "label"), repeats=2)
    models = ensembles.rusboost_folds(sides.where("split = 'train'"), df.select("id", "features"), n_rounds=4, metric=metric,
                                      **({"max_iter": 3, "min_iter": 3} if metric else {}))
    assert sorted(models) == ["0", "1"] and all(len(m.stumps) == 4 for m in models.values())
    assert all((m is not None) == metric for b in models.values() for m in b.maps)


def test_bagged_folds_equal_one_fold(spark):
    """Folds as members: votes of every fold's test rows; more than 15 classes have slots of their own."""
    from rarefold.operators import splits
    df, X, y = _planted(spark, 90)
    sides = splits.stratified_holdout(df.select("id", "label"), repeats=2)
    got = ensembles.mlbagging_folds(sides, df.select("id", "features"), n_bags=2, max_iter=2, min_iter=2).collect()
    assert {(r.repeat, r.qid) for r in got} == {(r.repeat, r.id) for r in sides.where("split = 'test'").collect()}
    assert all(0 <= r.proba <= 1 for r in got)
    many = spark.createDataFrame([(i, [float(i)], i % 20) for i in range(200)], "id long, features array<double>, label int")
    slots = ensembles.bag_slots(many, 2).select("bag", "uid").collect()
    assert len(set(slots)) == len(slots)


def test_bagging_takes_any_base_learner(spark):
    """The same bags with k-NN and with stumps, each equal to its own definition."""
    from rarefold.operators import learners, neighbors, splits
    df, X, y = _planted(spark, 90)
    sides = splits.stratified_holdout(df.select("id", "label"), repeats=1)
    vectors = df.select("id", "features")
    run = lambda base: {r.qid: r.proba for r in ensembles.metric_bagging(
        sides, vectors, 3, base, learners.Identity()).collect()}
    bags = ensembles.bag_slots(sides.where("split = 'train'").select("repeat", "id", "label"), 3, member_cols=("repeat",), vectors=vectors)
    test = sides.where("split = 'test'").select("id").join(vectors, "id")
    knn, stump = {}, {}
    for b in range(3):
        own = bags.where(F.col("bag") == b)
        for r in neighbors.knn_predict(neighbors.knn(test, own, 5, train_uid="uid")).collect():
            knn.setdefault(r.qid, []).append(r.proba)
        model = stumps.fit_boost(own.select("id", "features", "label"), 1)
        for r in stumps.predict_boost(test, model).collect():
            stump.setdefault(r.id, []).append(r.proba)
    for got, want in ((run(learners.KNN()), knn), (run(learners.Stump()), stump)):
        assert set(got) == set(want) and all(got[i] == pytest.approx(np.mean(want[i])) for i in want)


def test_stacking_and_boost_stacking_take_plug_ins(spark):
    from rarefold.operators import learners

    class Share:
        """A base learner of a few lines: the member's share of positives."""
        def probas(self, train, test, member_col):
            share = train.groupBy(member_col).agg(F.avg("label").alias("proba"))
            return test.join(share, member_col).select(member_col, "id", "proba")

    df, X, y = _planted(spark, 60)
    meta = ensembles.stacking_meta(df, 2, base=Share(), metric=learners.Identity()).collect()
    assert len(meta) == 60 and all(r.features == [0.5, 0.5, *X[r.id]] for r in meta)
    all_rows = ensembles.stacking_meta(df, 2, base=Share(), metric=learners.Identity(), sampling={}).collect()
    assert all(0.1 < r.features[0] < 0.25 for r in all_rows)                # nothing is left out
    lm = ensembles.stacking_meta(df, 1, base=learners.KNN(3), metric=learners.LMNN(options={"max_iter": 2, "min_iter": 2})).collect()
    assert len(lm) == 60 and {round(3 * r.features[0]) for r in lm} <= {0, 1, 2, 3}
    for base in (learners.KNN(3), learners.Stump()):
        model = ensembles.mlboostacking_fit(df, max_iteration=1, n_bags=2, n_rounds=2, base=base, metric=learners.Identity())
        z = {r.id: r.features for r in ensembles.mlboostacking_transform(df, model).collect()}
        assert all(z[i] == pytest.approx(X[i].tolist()) for i in range(60)) and len(model.iterations) == 1


def test_weights_go_to_the_stump_and_not_to_the_metric(spark):
    """H2: a round's map is that of its plain sample; its stump is the best one under the round's weights in the mapped space."""
    df, X, y = _planted(spark, 48, seed=4)
    kw = {"max_iter": 3, "min_iter": 3}
    model = ensembles.rusboost_fit(df, n_rounds=3, metric=True, **kw)["0"]
    draws = resample.rus_rounds(df.select("id", "label"), 3)
    total = np.zeros(len(y))
    for r, (st, L) in enumerate(zip(model.stumps, model.maps)):
        own = draws.where(F.col("round") == r).join(df.select("id", "features"), "id")
        assert np.allclose(L, lmnn.fit(own, **kw).maps["0"], atol=1e-9)
        ids = [x.id for x in own.select("id").collect()]
        Z = X @ L.T
        lo, hi = Z.min(axis=0), Z.max(axis=0)
        B = np.clip(np.floor((Z - lo) / ((hi - lo) / stumps.N_BINS)), 0, stumps.N_BINS - 1).astype(int)
        w = np.exp(-0.5 * (2 * y - 1) * total)
        h = np.zeros((2, 3, stumps.N_BINS))
        for i in ids:
            for f in range(3):
                h[y[i], f, B[i, f]] += w[i]
        f, b, pl, pr, _ = stumps.best_split_np(h[0], h[1])
        assert (st.feature, st.bin) == (f, b) and st.p_left == pytest.approx(pl) and st.p_right == pytest.approx(pr)
        total += np.where(B[:, f] <= b, stumps.leaf_log_odds(pl), stumps.leaf_log_odds(pr))


def test_lmnn_tiles_copy_a_row_once_per_side(spark, monkeypatch):
    df, X, y = _planted(spark, 400, seed=12)
    blocks = lmnn.prepare(df, 3, None, 10)
    pairs = lmnn.active_pairs(blocks, {"0": np.eye(X.shape[1])})
    n = sum(x[-1] for x in blocks.names)
    monkeypatch.setattr(lmnn, "SIDES", 2)
    assert lmnn._dealt(blocks, pairs)[2] <= 10 * n           # 4 blocks a side: more than 20 times the rows
    monkeypatch.setattr(lmnn, "TILE_ROWS", 10)
    assert lmnn._dealt(blocks, pairs)[2] > 20 * n


@pytest.mark.parametrize("keep", [0, 8])
def test_lmnn_members_alone_and_over_tiles_alike(spark, monkeypatch, keep):
    df, X, y = _planted(spark, 150, seed=13)
    two = df.withColumn("m", F.lit("a")).unionByName(df.where("id < 90").withColumn("m", F.lit("b")))
    alone = lmnn.fit(two, max_iter=15, min_iter=15, tol=0.0, member_col="m", block_rows=25)
    monkeypatch.setattr(lmnn, "LOCAL_ROWS", 0)
    monkeypatch.setattr(lmnn, "TILE_ROWS", 50)
    monkeypatch.setattr(lmnn, "SIDES", 1)
    monkeypatch.setattr(lmnn, "KEEP", keep)
    tiled = lmnn.fit(two, max_iter=15, min_iter=15, tol=0.0, member_col="m", block_rows=25)
    assert set(alone.maps) == set(tiled.maps) == {"a", "b"}
    assert all(np.allclose(alone.maps[m], tiled.maps[m], atol=1e-8) for m in alone.maps)
    assert [h["accepted"] for h in alone.history] == [h["accepted"] for h in tiled.history]


def test_row_tables_do_not_pass_through_the_driver(spark):
    """Id tables are small as files; neither they nor the offsets of their ranks are broadcast."""
    from rarefold.operators import rank, resample
    from rarefold.session import materialize
    ids = materialize(spark.range(200).selectExpr("id", "cast(id % 5 = 0 as int) as label", "cast(id % 3 as int) as repeat"), "ids")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ranked = rank.dist_rank(ids.withColumn("h", F.md5(F.col("id").cast("string"))), ["repeat"], "h", "id")
    assert "BroadcastHashJoin" not in plan(ranked) and "SortMergeJoin" in plan(ranked)
    vectors = ids.select("id", F.array(F.col("id").cast("double")).alias("features"))
    bags = ensembles.bag_slots(ids, 2, member_cols=("repeat",), vectors=vectors)
    hit = [x for x in plan(bags).split("\n") if "BroadcastHashJoin" in x and ("id#" in x.split("]")[0])]
    assert not hit
