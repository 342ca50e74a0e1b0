"""Registered queries: ensembles (I1-I7) on the hold-out fold of the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensembles, learners, splits
from ..operators.stumps import LEAF_CLIP, N_BINS as NB
from . import fixtures as fx
from .catalog import H, U, register

N_BAGS = 10


def _fold0(spark, sf):
    folds = splits.stratified_holdout(fx.vec_bin(spark, sf), repeats=1)
    tr = folds.filter(F.col("split") == "train").drop("split", "repeat")
    te = folds.filter(F.col("split") == "test").drop("split", "repeat")
    return tr, te


SQL_FOLD0 = f"""WITH {fx.SQL_VEC_BIN},
hs AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H("'holdout'", '0', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY label) AS nc FROM vec_bin),
tr AS (SELECT id, features, label FROM hs WHERE rk > round(0.2 * nc)),
te AS (SELECT id, features, label FROM hs WHERE rk <= round(0.2 * nc))"""


def sql_bootstrap(src: str, n_bags: int = N_BAGS) -> str:
    """R2 bag slots over CTE ``src(id, features, label)`` -> CTE ``slots``."""
    return f"""bidx AS (SELECT id, label, features, row_number() OVER (ORDER BY {H("'boot-idx'", 'id')}, id) - 1 AS idx,
                count(*) OVER () AS n FROM {src}),
bslots AS (SELECT CAST(b.bag AS INTEGER) AS bag, i.id AS slot,
                  CAST(floor({U("'boot'", 'b.bag', 'i.id')} * i.n) AS BIGINT) AS idx FROM bidx i, range(0, {n_bags}) b(bag)),
boot AS (SELECT s.bag, s.slot, i.id, i.label, i.features FROM bslots s JOIN bidx i ON s.idx = i.idx),
bcnt AS (SELECT bag, label, count(*) AS c FROM boot GROUP BY bag, label),
bcr AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY c, label) = 1 AS is_min FROM bcnt),
bkeep AS (SELECT b.bag, 'keep' AS src, b.slot, b.id, b.label, b.features FROM boot b
          JOIN bcr ON b.bag = bcr.bag AND b.label = bcr.label WHERE bcr.is_min),
bmaj AS (SELECT b.*, row_number() OVER (PARTITION BY b.bag, b.label ORDER BY {H("'boot-maj'", 'b.bag', 'b.slot')}, b.slot) - 1 AS idx
         FROM boot b JOIN bcr ON b.bag = bcr.bag AND b.label = bcr.label WHERE NOT bcr.is_min),
bdraws AS (SELECT k.bag, o.label, k.slot AS drv,
                  CAST(floor({U("'boot-draw'", 'k.bag', 'o.label', 'k.slot')} * o.c) AS BIGINT) AS idx
           FROM bkeep k JOIN bcr o ON k.bag = o.bag AND NOT o.is_min),
slots AS (
  SELECT bag, slot, id, label, features, slot * 16 AS uid FROM bkeep
  UNION ALL
  SELECT d.bag, d.drv AS slot, m.id, m.label, m.features, d.drv * 16 + 1 + m.label AS uid
  FROM bdraws d JOIN bmaj m ON d.bag = m.bag AND d.label = m.label AND d.idx = m.idx)"""


@register("i3_i7_bagged_knn_identity", SQL_FOLD0 + ",\n" + sql_bootstrap("tr") + """,
pairs AS (SELECT te.id AS qid, s.bag, s.id AS tid, s.uid, s.label AS tl,
                 list_sum(list_transform(list_zip(te.features, s.features), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
          FROM te, slots s),
nb AS (SELECT *, row_number() OVER (PARTITION BY bag, qid ORDER BY d2, tid, uid) AS r FROM pairs),
pb AS (SELECT bag, qid, avg(tl::DOUBLE) AS p FROM nb WHERE r <= 5 GROUP BY bag, qid)
SELECT qid, round(avg(p), 6) AS proba, CAST(round(avg(p), 12) > 0.5 AS INTEGER) AS pred FROM pb GROUP BY qid""")
def i3_i7_bagged_knn_identity(spark, sf):
    """Metric bagging with the identity metric: balanced bootstrap bags,
    k-NN per bag, soft vote of the bags."""
    tr, te = _fold0(spark, sf)
    model = ensembles.mlbagging_fit(tr, N_BAGS, k=5, metric=False)
    out = ensembles.mlbagging_predict(te, model)
    return out.select("qid", F.round("proba", 6).alias("proba"), "pred")


@register("i1_easy_ensemble", None)
def i1_easy_ensemble(spark, sf):
    """10 under-sampled bags x 50 SAMME stumps, mean probability (baseline 1)."""
    tr, te = _fold0(spark, sf)
    models = ensembles.easy_ensemble_fit(tr)
    return ensembles.predict_mean(te, models).select("id", "label", F.round("proba", 6).alias("proba"), "pred")


@register("i2_rusboost", None)
def i2_rusboost(spark, sf):
    """50 rounds of SAMME.R, each stump fitted on that round's under-sample (baseline 2)."""
    tr, te = _fold0(spark, sf)
    models = ensembles.rusboost_fit(tr)
    return ensembles.predict_mean(te, models).select("id", "label", F.round("proba", 6).alias("proba"), "pred")


@register("i2_rusboost_round1", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H("'rusboost'", '0', 'id')}, id) AS rk,
             count(*) OVER (PARTITION BY label) AS nc FROM vec_bin),
sm AS (SELECT id FROM k WHERE rk <= (SELECT min(nc) FROM k)),
x AS (SELECT id, label, unnest(features) AS v, unnest(generate_series(0, len(features) - 1)) AS f FROM vec_bin),
e AS (SELECT f, min(v) AS lo, max(v) AS hi FROM x GROUP BY f),
bx AS (SELECT x.*, CAST(least(greatest(floor((v - e.lo) / ((e.hi - e.lo) / {NB})), 0), {NB - 1}) AS INTEGER) AS b
       FROM x JOIN e ON x.f = e.f),
h AS (SELECT f, b, sum(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS w0, sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS w1
      FROM bx JOIN sm USING (id) GROUP BY f, b),
s AS (SELECT f, b, sum(w0) OVER (PARTITION BY f ORDER BY b) AS l0, sum(w1) OVER (PARTITION BY f ORDER BY b) AS l1,
             sum(w0) OVER (PARTITION BY f) AS t0, sum(w1) OVER (PARTITION BY f) AS t1 FROM h),
c AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM s),
g AS (SELECT f, b, l1 / (l0 + l1) AS p_left, r1 / (r0 + r1) AS p_right,
             round((1 - (t0 / (t0 + t1)) ** 2 - (t1 / (t0 + t1)) ** 2)
               - (l0 + l1) / (t0 + t1) * (1 - (l0 / (l0 + l1)) ** 2 - (l1 / (l0 + l1)) ** 2)
               - (r0 + r1) / (t0 + t1) * (1 - (r0 / (r0 + r1)) ** 2 - (r1 / (r0 + r1)) ** 2), 9) AS gain
      FROM c WHERE l0 + l1 > 0 AND r0 + r1 > 0),
best AS (SELECT * FROM g ORDER BY gain DESC, f, b LIMIT 1),
od AS (SELECT bx.id, bx.label, CASE WHEN bx.b <= best.b THEN p_left ELSE p_right END AS p FROM bx JOIN best ON bx.f = best.f),
cl AS (SELECT id, label, least(greatest(p, {LEAF_CLIP}), 1 - {LEAF_CLIP}) AS p FROM od)
SELECT id, label, round(p, 6) AS proba, CAST(p > 0.5 AS INTEGER) AS pred,
       round(exp(-0.5 * (2 * label - 1) * ln(p / (1 - p))) / sum(exp(-0.5 * (2 * label - 1) * ln(p / (1 - p)))) OVER (), 9) AS next_weight
FROM cl""")
def i2_rusboost_round1(spark, sf):
    """First round of RUSBoost on the whole table: the under-sample's stump, its
    probabilities, and the weights that the second round starts from."""
    v = fx.vec_bin(spark, sf)
    models = ensembles.rusboost_fit(v, n_rounds=1)
    out = ensembles.predict_mean(v, models)
    odds = F.log(F.col("proba") / (1 - F.col("proba")))
    w = F.exp(F.lit(-0.5) * (2 * F.col("label") - 1) * odds - F.lit(models["0"].norm))
    return out.select("id", "label", F.round("proba", 6).alias("proba"), "pred", F.round(w, 9).alias("next_weight"))


@register("i3_mlbagging", None)
def i3_mlbagging(spark, sf):
    """Balanced bootstrap bags, LMNN per bag (one set of jobs), k-NN, soft vote."""
    tr, te = _fold0(spark, sf)
    model = ensembles.mlbagging_fit(tr, N_BAGS, k=5)
    return ensembles.mlbagging_predict(te, model).select("qid", F.round("proba", 6).alias("proba"), "pred")


@register("i4_mlboosting", None)
def i4_mlboosting(spark, sf):
    """RUSBoost with LMNN -> stump weak learners."""
    tr, te = _fold0(spark, sf)
    models = ensembles.mlboosting_fit(tr)
    return ensembles.predict_mean(te, models).select("id", "label", F.round("proba", 6).alias("proba"), "pred")


@register("i5_mlstacking", None)
def i5_mlstacking(spark, sf):
    """10 x (under-sample -> LMNN -> AdaBoost), out-of-fold stacking, EasyEnsemble."""
    tr, te = _fold0(spark, sf)
    model = ensembles.mlstacking_fit(tr)
    return ensembles.mlstacking_predict(te, model).select("id", "label", F.round("proba", 6).alias("proba"), "pred")


META_ESTIMATORS = 3


@register("i5_meta_rows", f"""WITH {fx.SQL_VEC_BIN},
o AS (SELECT id, label, features, CAST((row_number() OVER (PARTITION BY label ORDER BY {H("'oof'", 'id')}, id) - 1) % 5 AS INTEGER) AS oof FROM vec_bin),
m AS (SELECT e.e || ':' || f.f AS member, o.id, o.label, o.features FROM o, range(0, {META_ESTIMATORS}) e(e), range(0, 5) f(f) WHERE f.f <> o.oof),
k AS (SELECT *, row_number() OVER (PARTITION BY member, label ORDER BY {H("'i5'", 'member', 'id')}, id) AS rk,
             count(*) OVER (PARTITION BY member, label) AS nc FROM m),
us AS (SELECT member, id, label, features FROM (SELECT *, min(nc) OVER (PARTITION BY member) AS nmin FROM k) WHERE rk <= nmin),
x AS (SELECT member, id, label, unnest(features) AS v, unnest(generate_series(0, len(features) - 1)) AS f FROM us),
ed AS (SELECT member, f, min(v) AS lo, max(v) AS hi FROM x GROUP BY member, f),
h AS (SELECT x.member, x.f, CAST(least(greatest(floor((v - lo) / ((hi - lo) / {NB})), 0), {NB - 1}) AS INTEGER) AS b,
             sum(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS w0, sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS w1
      FROM x JOIN ed ON x.member = ed.member AND x.f = ed.f GROUP BY x.member, x.f, b),
s AS (SELECT member, f, b, sum(w0) OVER (PARTITION BY member, f ORDER BY b) AS l0, sum(w1) OVER (PARTITION BY member, f ORDER BY b) AS l1,
             sum(w0) OVER (PARTITION BY member, f) AS t0, sum(w1) OVER (PARTITION BY member, f) AS t1 FROM h),
c AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM s),
g AS (SELECT member, f, b, l1 / (l0 + l1) AS p_left, r1 / (r0 + r1) AS p_right,
             round((1 - (t0 / (t0 + t1)) ** 2 - (t1 / (t0 + t1)) ** 2)
               - (l0 + l1) / (t0 + t1) * (1 - (l0 / (l0 + l1)) ** 2 - (l1 / (l0 + l1)) ** 2)
               - (r0 + r1) / (t0 + t1) * (1 - (r0 / (r0 + r1)) ** 2 - (r1 / (r0 + r1)) ** 2), 9) AS gain
      FROM c WHERE l0 + l1 > 0 AND r0 + r1 > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY gain DESC, f, b) AS r FROM g) WHERE r = 1),
pr AS (SELECT o.id, e.e, CASE WHEN least(greatest(floor((o.features[best.f + 1] - ed.lo) / ((ed.hi - ed.lo) / {NB})), 0), {NB - 1}) <= best.b
                              THEN p_left ELSE p_right END AS p
       FROM o, range(0, {META_ESTIMATORS}) e(e) JOIN best ON best.member = e.e || ':' || o.oof
       JOIN ed ON ed.member = best.member AND ed.f = best.f),
mt AS (SELECT id, list(round(CASE WHEN p > 0.5 THEN 1 / (1 + exp(-2)) ELSE 1 / (1 + exp(2)) END, 6) ORDER BY e) AS meta FROM pr GROUP BY id)
SELECT o.id, o.label, list_concat(mt.meta, list_transform(o.features, lambda v: round(v, 6))) AS features FROM o JOIN mt ON o.id = mt.id""")
def i5_meta_rows(spark, sf):
    """Stacking's meta rows (identity metric, one stump per estimator): the
    out-of-fold P(1) of every estimator, then the row's features."""
    meta = ensembles.stacking_meta(fx.vec_bin(spark, sf), META_ESTIMATORS, base=learners.Stump(), metric=learners.Identity())
    return meta.select("id", "label", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@register("i3_mlbagging_stumps", None)
def i3_mlbagging_stumps(spark, sf):
    """Metric bagging of the hold-out folds with boosted stumps in the place of k-NN."""
    v = fx.vec_bin(spark, sf)
    folds = splits.stratified_holdout(v.select("id", "label"), repeats=10)
    out = ensembles.metric_bagging(folds, v.select("id", "features"), N_BAGS, learners.Boosted(10), learners.Identity())
    return out.select("repeat", "qid", F.round("proba", 6).alias("proba"), "pred")


@register("i6_mlboostacking", None)
def i6_mlboostacking(spark, sf):
    """10 iterations of map learning with train/valid re-division, then
    EasyEnsemble in the concatenated metric space."""
    tr, te = _fold0(spark, sf)
    model = ensembles.mlboostacking_fit(tr, max_iteration=10)
    return ensembles.mlboostacking_predict(te, model).select("id", "label", F.round("proba", 6).alias("proba"), "pred")


@register("i6a_redivision_identity", f"""WITH {fx.SQL_VEC_BIN},
k AS (SELECT id, features, label, row_number() OVER (ORDER BY {H("'c4'", 'id')}, id) AS rk,
             count(*) OVER () AS n FROM vec_bin),
st AS (SELECT id, features, label, CASE WHEN rk <= floor(n / 2) THEN 'train' ELSE 'valid' END AS side,
              floor(n / 2) AS ntr FROM k),
tr AS (SELECT * FROM st WHERE side = 'train'),
va AS (SELECT * FROM st WHERE side = 'valid'),
pairs AS (SELECT va.id AS qid, va.label AS y, tr.id AS tid, tr.label AS tl,
                 list_sum(list_transform(list_zip(va.features, tr.features), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
          FROM va, tr),
nb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS r FROM pairs),
pp AS (SELECT qid, any_value(y) AS y, CAST(avg(tl::DOUBLE) > 0.5 AS INTEGER) AS pred FROM nb WHERE r <= 5 GROUP BY qid),
mv AS (SELECT st.id, st.ntr, coalesce(st.side = 'valid' AND pp.pred <> pp.y, false) AS moved
       FROM st LEFT JOIN pp ON st.id = pp.qid),
r2 AS (SELECT id, ntr, row_number() OVER (ORDER BY (CASE WHEN moved THEN '0' ELSE '1' END) || {H("'i6'", '0', 'id')}, id) AS r
       FROM mv)
SELECT id, CASE WHEN r <= ntr THEN 'train' ELSE 'valid' END AS side FROM r2""")
def i6a_redivision_identity(spark, sf):
    """First re-division of boost-stacking with the identity metric: k-NN on
    the train half scores the valid half; misclassified valid rows move to
    train, which is refilled in seeded order to its old size."""
    from ..operators import neighbors
    v = fx.vec_bin(spark, sf)
    halves = splits.random_halves(v)
    state = halves.select("id", F.when(F.col("split") == "train", "train")
                          .otherwise("valid").alias("side"))
    n_train = state.filter(F.col("side") == "train").count()
    tr = halves.filter(F.col("split") == "train")
    va = halves.filter(F.col("split") == "valid")
    pred = neighbors.knn_predict(neighbors.knn(va, tr, 5)).join(
        va.select(F.col("id").alias("qid"), "label"), on="qid")
    correct = pred.select(F.col("qid").alias("id"), (F.col("pred") == F.col("label")).alias("correct"))
    return ensembles.redivide(state, correct, n_train, 0)
