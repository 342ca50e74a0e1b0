"""Scans in single precision (LMNN triplets, nearest rows) and members fitted by a task each."""

import numpy as np
import pytest

from rarefold.operators import blocks, lmnn, neighbors


def _brute(X, T, Z, L):
    """Counts per target, impostors per row, hinge sum and gradient (mu = 1) of X's rows against Z's."""
    dt = 1.0 + (((X[:, None] - T) @ L.T) ** 2).sum(-1)
    dl = (((X[:, None] - Z[None]) @ L.T) ** 2).sum(-1)
    H = dt[:, None, :] - dl[:, :, None]
    act = H > 0
    C = lambda D: D[:, :, None] * D[:, None, :]
    G = np.zeros((X.shape[1],) * 2)
    for i in range(len(X)):
        for j in range(T.shape[1]):
            l = np.flatnonzero(act[i, :, j])
            G += len(l) * C(X[i:i + 1] - T[i, j])[0] - C(X[i] - Z[l]).sum(axis=0)
    return act.sum(axis=1), act.any(axis=2).sum(axis=1), np.maximum(H, 0).sum(), G


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (0.0, 6.0), (300.0, 4.0), (0.0, 1e-3), (0.0, 1e20)])
def test_triplets_are_exact_whatever_single_precision_makes_of_them(offset, scale):
    rng = np.random.default_rng(1)
    A, B = rng.normal(size=(70, 5)) + offset, rng.normal(size=(90, 5)) + offset
    A[10:20], B[5] = A[3], A[3]                             # equal rows, also across classes
    m = np.ones((70, 3), bool), np.ones((90, 3), bool)
    T = A[rng.integers(0, 70, (70, 3))], B[rng.integers(0, 90, (90, 3))]
    T[0][10:20] = T[0][3]
    L = scale * (np.eye(5) + 0.1 * rng.normal(size=(5, 5)))
    a, b = _brute(A, T[0], B, L), _brute(B, T[1], A, L)
    G, hinge, n, act, imp = lmnn.cell_terms(A, T[0], m[0], B, L, 1.0)
    assert hinge == pytest.approx(a[2], rel=1e-9) and np.allclose(G, a[3], rtol=1e-7, atol=1e-7 * np.abs(a[3]).max())
    if offset == 0.0 and scale < 1e10:                      # else ties are decided by rounding
        assert (act == a[0].sum(axis=1)).all() and (imp == a[1]).all() and n == a[0].sum()
    sides = [lmnn.Side.compact(A, T[0], m[0]), lmnn.Side.compact(B, T[1], m[1])]
    assert len(sides[0].X) == 60 and sides[0].w.sum() == 70
    hinge, G = lmnn.member_terms(sides, L, 1.0)
    assert hinge == pytest.approx(a[2] + b[2], rel=1e-9) and np.allclose(G, a[3] + b[3], rtol=1e-7, atol=1e-7 * np.abs(a[3] + b[3]).max())


def test_few_active_triplets_are_measured_one_by_one(monkeypatch):
    """Far classes: a step measures a few pairs and passes no block of all pairs."""
    rng = np.random.default_rng(2)
    A, B = rng.normal(size=(600, 8)), rng.normal(size=(600, 8)) + 1.2
    T = [X[neighbors.targets_of(X, np.arange(600), 3)[0]] for X in (A, B)]
    m = np.ones((600, 3), bool)
    monkeypatch.setattr(lmnn, "_dense", lambda *a: pytest.fail("all pairs were measured"))
    measured, sparse = [], lmnn._sparse
    monkeypatch.setattr(lmnn, "_sparse", lambda side, left, r, *a: measured.append(len(r)) or sparse(side, left, r, *a))
    L = 4.0 * np.eye(8)
    hinge, _ = lmnn.member_terms([lmnn.Side(A, T[0], m), lmnn.Side(B, T[1], m)], L, 0.5)
    want = [_brute(A, T[0], B, L), _brute(B, T[1], A, L)]
    assert hinge == pytest.approx(sum(w[2] for w in want)) and 0 < sum(measured) < 0.05 * 2 * 600 * 600
    assert sum(measured) >= sum(w[1].sum() for w in want)


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (1000.0, 1.0), (0.0, 1e-12), (0.0, 1e25)])
def test_nearest_rows_are_exact(monkeypatch, offset, scale):
    monkeypatch.setattr(neighbors, "COLS", 64)
    monkeypatch.setattr(neighbors, "FIRST", 40)
    rng = np.random.default_rng(3)
    X = scale * (rng.normal(size=(300, 6)) + offset)
    X[50:60] = X[7]                                         # ties go by id
    ids = rng.permutation(300)
    ids[100] = ids[101]                                     # an id that comes twice
    at, have = neighbors.targets_of(X, ids, 3)
    assert have.all()
    for i in range(300):
        d = ((X - X[i]) ** 2).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        want = other[np.lexsort((ids[other], d[other]))][:3]
        assert (d[at[i]] == d[want]).all() and (ids[at[i]] == ids[want]).all()
    at, have = neighbors.targets_of(X[:2], np.array([4, 4]), 3)
    assert not have.any()


def test_scan_bound_and_hits():
    rng = np.random.default_rng(4)
    Q, R = rng.normal(size=(40, 9)) + 50.0, rng.normal(size=(56, 9)) + 50.0
    qn, rn = (Q ** 2).sum(axis=1), (R ** 2).sum(axis=1)
    d2 = ((Q[:, None] - R[None]) ** 2).sum(-1)
    S = blocks.lifted(Q, qn, True) @ blocks.lifted(R, rn, False).T
    for limit in (d2.min(), np.median(d2), d2.max()):
        M = S > blocks.scan_bound(np.full(40, limit), qn, rn.max(), 9)[:, None]
        assert M[d2 <= limit].all()
        assert (blocks.hits(M) == np.flatnonzero(M)).all()
    odd = rng.random((3, 5)) > 0.5
    assert (blocks.hits(odd) == np.flatnonzero(odd)).all()


def test_members_are_fitted_by_a_task_each_without_written_blocks(spark, monkeypatch):
    """Members of more rows than 16,384 too, if there are as many as cores."""
    rng = np.random.default_rng(5)
    X, y = rng.normal(size=(60, 3)), np.arange(60) % 2
    rows = [(str(m), i, [float(v) for v in X[i]], int(y[i])) for m in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "m string, id long, features array<double>, label int").repartition(3)
    monkeypatch.setattr(lmnn, "_blocks", lambda *a: pytest.fail("blocks were written"))
    monkeypatch.setattr(lmnn, "ALONE_ROWS", 10)
    model = lmnn.fit(df, max_iter=4, min_iter=4, member_col="m")
    assert sorted(model.maps) == ["0", "1", "2", "3"] and all(np.array_equal(model.maps["0"], L) for L in model.maps.values())
    big = spark.range(4 * 17_000).selectExpr("cast(id % 4 as string) as _m", "id", "array(1d, 2d) as features", "1 as label")
    assert lmnn._local_members(big, 3) == (["0", "1", "2", "3"], [])
    monkeypatch.setattr(lmnn, "LOCAL_BYTES", 17_000 * 2 * 8 * 4 - 1)
    assert lmnn._local_members(big, 3) == ([], ["0", "1", "2", "3"])
