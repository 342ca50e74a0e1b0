"""Exact k nearest neighbours on Voronoi cells: equal to brute force, and fewer row copies than all pairs."""

import numpy as np
import pytest

from rarefold.operators import neighbors, voronoi


def _table(spark, X, fold, y):
    return spark.createDataFrame([(int(f), i, [float(v) for v in x], int(t)) for i, (x, f, t) in enumerate(zip(X, fold, y))],
                                 "fold int, id long, features array<double>, label int")


def _clustered(n=600, d=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=8.0, size=(12, d))
    X = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d))
    X[50:60] = X[49]                                  # equal vectors
    return X, rng.integers(0, 2, n), (rng.random(n) < 0.3).astype(int)


def _brute(X, fold, q, t, k, same=False):
    out = set()
    for i in q:
        own = [j for j in t if fold[j] == fold[i] and not (same and i == j)]
        d = {j: float(((X[i] - X[j]) ** 2).sum()) for j in own}
        out |= {(int(fold[i]), i, r + 1, j) for r, j in enumerate(sorted(own, key=lambda j: (d[j], j))[:k])}
    return out


@pytest.mark.parametrize("cell_rows, k", [(20, 5), (7, 3), (600, 5), (3, 9)])
def test_equal_to_brute_force(spark, cell_rows, k):
    X, fold, y = _clustered()
    df = _table(spark, X, fold, y)
    got = neighbors.knn(df.where("id < 150"), df.where("id >= 150"), k, key_cols=["fold"], block_rows=16, cell_rows=cell_rows).collect()
    assert {(r.fold, r.qid, r.nbr_rank, r.nbr_id) for r in got} == _brute(X, fold, range(150), range(150, 600), k)
    assert all(r.dist == pytest.approx(np.linalg.norm(X[r.qid] - X[r.nbr_id])) for r in got)


def test_targets_exclude_the_row_itself(spark):
    X, fold, y = _clustered(200)
    got = neighbors.target_neighbors(_table(spark, X, fold, y), 3, cell_rows=10).collect()
    assert {(r.label, r.qid, r.nbr_rank, r.nbr_id) for r in got} == _brute(X, y, range(200), range(200), 3, same=True)


def test_cells_copy_fewer_rows_than_all_pairs(spark):
    X, fold, y = _clustered(2000, seed=1)
    df = _table(spark, X, np.zeros(2000), y).selectExpr("fold", "id as _qid", "id as _tuid", "features as _f")
    pv = voronoi.pivots(df, ["fold"], "_tuid", "_f", 50)
    cells = voronoi.cell_stats(voronoi.assign(df, pv, ["fold"], "_f"), pv, ["fold"])
    n_cells = len(pv["0"])
    assert n_cells == 40 and cells["0"].n.sum() == 2000
    from pyspark.sql import functions as F
    q = neighbors._own_cells(df.drop("_tuid"), cells, ["fold"]).withColumn("_kth", F.lit(None).cast("double"))
    copies = neighbors._further_cells(q, cells, ["fold"], 5).count() + 2000
    assert copies < 0.4 * 2000 * n_cells            # all pairs would send each row to every cell


def test_bounds_hold():
    rng = np.random.default_rng(2)
    X, Q, P = rng.normal(size=(400, 3)), rng.normal(size=(60, 3)), rng.normal(size=(9, 3))
    P[8] = P[7]
    D = voronoi.distances(X, P)
    own = D.argmin(axis=1)
    n = np.bincount(own, minlength=9)
    near, far = (np.array([f(D[own == j, j]) if n[j] else e for j in range(9)]) for f, e in ((np.min, np.inf), (np.max, 0.0)))
    c, DQ = voronoi.Cells(P, n, near, far), voronoi.distances(Q, P)
    low, up = voronoi.lower_bounds(c, DQ), voronoi.upper_bound(c, DQ, 5)
    for i, q in enumerate(Q):
        d = np.linalg.norm(X - q, axis=1)
        assert np.sort(d)[4] <= up[i] + 1e-9
        assert all(low[i, j] <= d[own == j].min() + 1e-9 for j in range(9) if n[j])
    assert np.isinf(voronoi.upper_bound(c, DQ, 401)).all()


@pytest.mark.parametrize("cell_rows", [4, 1000])
def test_keys_without_training_rows(spark, cell_rows):
    X, fold, y = _clustered(60)
    df = _table(spark, X, fold, y)
    nb = neighbors.knn(df.where("id < 20"), df.where("id >= 20 and fold = 0"), 3, key_cols=["fold"], cell_rows=cell_rows)
    rows = nb.collect()
    lost = {i for i in range(20) if fold[i] == 1}
    assert {r.qid for r in rows if r.nbr_id is None} == lost and len(rows) == len(lost) + 3 * (20 - len(lost))
    pred = {r.qid: r.proba for r in neighbors.knn_predict(nb, ["fold"]).collect()}
    assert len(pred) == 20 and {i for i, p in pred.items() if p is None} == lost
    assert neighbors.knn(df.limit(0), df, 3, key_cols=["fold"], cell_rows=cell_rows).count() == 0
    assert neighbors.knn(df, df.limit(0), 3, cell_rows=cell_rows).where("nbr_id is not null").count() == 0


def test_a_query_goes_to_a_slot_once(spark, monkeypatch):
    """Vectors without structure: a copy per slot, not per cell; the neighbours are the same."""
    rng = np.random.default_rng(7)
    X, fold, y = rng.normal(size=(900, 16)), np.zeros(900, int), rng.integers(0, 2, 900)
    df = _table(spark, X, fold, y)
    want = [sorted(map(tuple, neighbors.knn(df, df, 4, exclude_self=True).select("qid", "nbr_rank", "nbr_id").collect()))]
    sent = []
    further = neighbors._further_cells
    monkeypatch.setattr(neighbors, "_further_cells", lambda *a: sent.append(further(*a)) or sent[-1])
    for slot_rows in (60, 400):
        monkeypatch.setattr(neighbors, "SLOT_ROWS", slot_rows)
        monkeypatch.setattr(neighbors, "SLOTS", 1)
        got = neighbors.knn(df, df, 4, exclude_self=True, block_rows=10, cell_rows=10)
        assert sorted(map(tuple, got.select("qid", "nbr_rank", "nbr_id").collect())) == want[0]
    assert sent[1].count() <= 900 * 4 < sent[0].count()         # 90 cells in 3 or 4 slots


def test_equal_vectors_of_a_block_are_passed_once():
    R = np.repeat(np.eye(3), 50, axis=0)
    tid, tuid = np.arange(150) // 2, np.arange(150)
    keep = neighbors._first_copies(R, tid, tuid, 3)
    assert keep.tolist() == [v * 50 + i for v in range(3) for i in range(8)]       # four ids of two rows
    assert neighbors._first_copies(np.eye(3), tid[:3], tuid[:3], 3).tolist() == [0, 1, 2]
