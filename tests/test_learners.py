"""Neighbours, scoring edges, LMNN and stumps against NumPy on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from rarefold.operators import lmnn, neighbors, scoring, stumps
from rarefold.plans import fixtures as fx


def _rows(spark, X, y, ids=None):
    ids = list(range(len(X))) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(v) for v in x], int(t)) for i, x, t in zip(ids, X, y)],
        "id long, features array<double>, label int")


def test_blocked_knn_equals_bruteforce_with_duplicates(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(120, 5))
    X[10] = X[11]                                   # duplicate vectors
    y = (rng.random(120) < 0.3).astype(int)
    df = _rows(spark, X, y)
    q = df.filter("id < 40")
    t = df.filter("id >= 40")
    got = neighbors.knn(q, t, 5, block_rows=16).collect()   # many cells
    D = ((X[:40, None, :] - X[None, 40:, :]) ** 2).sum(-1)
    for r in got:
        order = sorted(range(80), key=lambda j: (D[r.qid, j], j + 40))
        assert r.nbr_id == order[r.nbr_rank - 1] + 40
    assert len(got) == 40 * 5


def test_class_smaller_than_k(spark):
    X = np.eye(4)
    df = _rows(spark, X, [0, 0, 1, 1])
    tn = neighbors.target_neighbors(df, 3).collect()
    assert all(r.nbr_rank == 1 for r in tn) and len(tn) == 4


def test_scorecard_edges(spark):
    one = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, pred int, proba double")
    c = scoring.scorecard_wide(one).first()
    assert c.tpr is None and c.auc is None           # one class only: undefined, not an error
    swap = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2)],
                                 "label int, pred int, proba double")
    s = scoring.scorecard_wide(swap).first()
    assert s.tpr == 1.0 and s.tnr == 0.5               # positives >= negatives: rates swap
    tied = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.5), (0, 1, 0.5)],
                                 "label int, pred int, proba double")
    assert scoring.auc(tied).first().auc == 0.5


def test_lmnn_loss_matches_numpy_and_never_rises(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 4))
    y = (np.arange(60) % 3 == 0).astype(int)
    df = _rows(spark, X, y)
    pull, push, _ = lmnn.loss_terms(df, k=3)
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    P = H = 0.0
    for i in range(60):
        same = [j for j in np.argsort(D[i], kind="stable") if j != i and y[j] == y[i]][:3]
        for j in same:
            P += D[i, j]
            for l in np.flatnonzero(y != y[i]):
                H += max(0.0, 1 + D[i, j] - D[i, l])
    assert pull == pytest.approx(P, rel=1e-9) and push == pytest.approx(H, rel=1e-9)
    model = lmnn.fit(df, max_iter=6, min_iter=6)
    acc = [h["loss"] for h in model.history if h["accepted"]]
    assert all(b <= a + 1e-12 for a, b in zip(acc, acc[1:]))


def test_stump_selection_numpy_equals_spark(spark):
    v = fx.vec_bin(spark, SF01)
    rows = stumps._with_member(v, None).withColumn("_in", F.lit(True))
    edges = stumps._edges_job(rows, {"0": None}, spark)
    hist = stumps.histogram(rows, {"0": stumps.Booster()}, edges, {"0": None})
    sp = stumps.best_splits(hist).first()
    h = {(r.label, r.f, r.b): r.w for r in hist.filter("kind = 'fit'").collect()}
    d = len(edges["0"][0])
    h0 = np.array([[h.get((0, f, b), 0.0) for b in range(32)] for f in range(d)])
    h1 = np.array([[h.get((1, f, b), 0.0) for b in range(32)] for f in range(d)])
    f, b, pl, pr, gain = stumps.best_split_np(h0, h1)
    assert (f, b) == (sp.feature, sp.bin) and pl == pytest.approx(sp.p_left)


def test_boosting_beats_majority_on_gmean(spark):
    v = fx.vec_bin(spark, SF01)
    models = stumps.fit_boost(v, n_rounds=10)
    p = stumps.predict_boost(v, models)
    card = scoring.scorecard_wide(p).first()
    assert card.gmean is not None and card.gmean > 0.0


def test_auc_ranges_equal_all_pairs(spark):
    """Many ranges per key, ties within and across classes: each pair counted once."""
    rng = np.random.default_rng(9)
    rows = [(int(k), int(y), float(s)) for k, y, s in zip(rng.integers(0, 3, 900), rng.random(900) < 0.2, np.round(rng.random(900), 2))]
    df = spark.createDataFrame(rows, "k int, label int, proba double").repartition(6)
    got = {r.k: r.auc for r in scoring.auc(df, ["k"]).collect()}
    for k in range(3):
        pos, neg = ([s for x, y, s in rows if x == k and y == v] for v in (1, 0))
        want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
        assert got[k] == pytest.approx(want)
    nulls = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, None)], "label int, proba double")
    assert scoring.auc(nulls).first().auc == 1.0
