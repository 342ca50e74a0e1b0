"""Projection-head fit (F5): exact gradient, Spark sums equal NumPy, loss drops."""

import numpy as np
import pytest

from conftest import SF01
from rarefold.operators import headfit
from rarefold.plans import fixtures as fx


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(3, 6, 4))
    y = rng.integers(0, 2, size=(3, 6))
    W = rng.normal(size=(5, 4)) * 0.5
    b = rng.normal(size=5) * 0.1
    for margin in (20.0, 0.3):                      # all active / some inactive
        _, _, gW, gb = headfit.batch_terms(X, y, W, b, margin)
        f = lambda W_, b_: headfit.batch_terms(X, y, W_, b_, margin, grad=False)[0].sum()
        eps = 1e-6
        for (i, j) in [(0, 0), (2, 3), (4, 1)]:
            Wp, Wm = W.copy(), W.copy()
            Wp[i, j] += eps
            Wm[i, j] -= eps
            assert (f(Wp, b) - f(Wm, b)) / (2 * eps) == pytest.approx(gW[i, j], abs=1e-7)
        e = np.eye(5)[2] * eps
        assert (f(W, b + e) - f(W, b - e)) / (2 * eps) == pytest.approx(gb[2], abs=1e-7)


def test_spark_batch_losses_equal_numpy_and_fit_lowers_loss(spark):
    v = fx.vec_bin(spark, SF01)
    W, b = headfit.init_head(64, 64)
    g = headfit.grouped_epoch(v, 0)
    got = {r.batch: r for r in headfit.batch_losses(g, W, b).collect()}
    for r in g.collect():
        loss, n, _, _ = headfit.batch_terms(np.array(r.xs)[None], np.array(r.labels)[None], W, b)
        assert got[r.batch].n_active == n[0]
        if n[0] == 0:
            assert got[r.batch].loss is None          # one class only: no triplet
        else:
            assert got[r.batch].loss == pytest.approx(loss[0], rel=1e-12)
    sizes = [len(r.labels) for r in g.collect()]
    assert sum(sizes) == v.count() and max(sizes) == 16
    before = headfit.epoch_loss(v, (W, b), epoch=7)[0]
    model = headfit.fit(v, epochs=3, steps_per_epoch=2)
    assert headfit.epoch_loss(v, model, epoch=7)[0] < before


def _sequential(groups, W, b, epochs, warmup, lr=0.05):
    opt = headfit.Adam(W, b, lr, warmup, sum(map(len, groups)), 0.01)
    for g in groups:
        for X, y in g:
            if len(y) > 1:
                _, _, gW, gb = headfit.batch_terms(X[None], y[None], *opt.p)
                opt.step(gW, gb)
    return opt


@pytest.mark.parametrize("run_batches", [2048, 30])
def test_an_epoch_is_one_job_and_one_run_is_the_sequential_fit(spark, run_batches):
    rng = np.random.default_rng(1)
    n = 960
    y = (np.arange(n) % 4 == 0).astype(int)
    X = rng.normal(size=(n, 5)) + 1.5 * y[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(n)], "id long, features array<double>, label int")
    W, b = headfit.init_head(5, 5)
    groups = [[(np.array(r.xs), np.array(r.labels)) for r in headfit.grouped_epoch(df, e).orderBy("batch").collect()] for e in range(3)]
    want = _sequential(groups, W, b, 3, 4)
    model = headfit.fit(df, epochs=3, warmup_steps=4, run_batches=run_batches)
    assert len(model.history) == 3 and all(h["batches"] == 60 for h in model.history)      # an entry, and a job, per epoch
    if run_batches > 60:
        assert np.allclose(model.W, want.p[0], atol=1e-10) and np.allclose(model.b, want.p[1], atol=1e-10)
    else:
        assert model.history[0]["runs"] == 2
        own, seq, start = (headfit.epoch_loss(df, p, epoch=9)[0] for p in (model, (want.p[0], want.p[1]), (W, b)))
        assert own < start and own - seq < 0.25 * (start - seq)        # averaged runs keep most of the gain


def test_jobs_per_epoch_do_not_depend_on_rows(spark):
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    for n in (64, 640):
        df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], i % 2) for i in range(n)], "id long, features array<double>, label int")
        group = f"head-{n}"
        spark.sparkContext.setJobGroup(group, group)
        headfit.fit(df, epochs=1, run_batches=8)
        one = len(tracker.getJobIdsForGroup(group))
        headfit.fit(df, epochs=3, run_batches=8)
        jobs.append((len(tracker.getJobIdsForGroup(group)) - one) - one)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 4          # adaptive plans split jobs a little differently; one per batch would be 72 more
