"""Registered queries: stumps and boosting (H1-H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stumps
from . import fixtures as fx
from .catalog import register

NB = stumps.N_BINS

SQL_STUMP = f"""WITH {fx.SQL_VEC_BIN},
x AS (SELECT id, label, unnest(features) AS v, unnest(generate_series(0, len(features) - 1)) AS f FROM vec_bin),
e AS (SELECT f, min(v) AS lo, max(v) AS hi FROM x GROUP BY f),
bx AS (SELECT x.*, e.lo, (e.hi - e.lo) / {NB} AS width,
              CAST(least(greatest(floor((v - e.lo) / ((e.hi - e.lo) / {NB})), 0), {NB - 1}) AS INTEGER) AS b
       FROM x JOIN e ON x.f = e.f),
h AS (SELECT f, b, sum(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS w0,
             sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS w1 FROM bx GROUP BY f, b),
s AS (SELECT f, b, sum(w0) OVER (PARTITION BY f ORDER BY b) AS l0, sum(w1) OVER (PARTITION BY f ORDER BY b) AS l1,
             sum(w0) OVER (PARTITION BY f) AS t0, sum(w1) OVER (PARTITION BY f) AS t1 FROM h),
c AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM s),
g AS (SELECT f, b, l1 / (l0 + l1) AS p_left, r1 / (r0 + r1) AS p_right,
             round((1 - (t0 / (t0 + t1)) ** 2 - (t1 / (t0 + t1)) ** 2)
               - (l0 + l1) / (t0 + t1) * (1 - (l0 / (l0 + l1)) ** 2 - (l1 / (l0 + l1)) ** 2)
               - (r0 + r1) / (t0 + t1) * (1 - (r0 / (r0 + r1)) ** 2 - (r1 / (r0 + r1)) ** 2), 9) AS gain
      FROM c WHERE l0 + l1 > 0 AND r0 + r1 > 0),
best AS (SELECT * FROM g ORDER BY gain DESC, f, b LIMIT 1),
pr AS (SELECT bx.id, bx.label, CASE WHEN bx.b <= best.b THEN best.p_left ELSE best.p_right END > 0.5 AS h
       FROM bx JOIN best ON bx.f = best.f),
er AS (SELECT avg(CAST(h <> (label = 1) AS DOUBLE)) AS err FROM pr)"""


def _round1(spark, sf):
    v = fx.vec_bin(spark, sf)
    return v, stumps.fit_boost(v, n_rounds=1)["0"]


@register("h1_stump_round1", SQL_STUMP + """
SELECT CAST(f AS INTEGER) AS feature, b AS bin, round(p_left, 6) AS p_left, round(p_right, 6) AS p_right,
       round(gain, 6) AS gain FROM best""")
def h1_stump_round1(spark, sf):
    v = fx.vec_bin(spark, sf)
    rows = stumps._with_member(v, None).withColumn("_in", F.lit(True))
    edges = stumps._edges_job(rows, {"0": None}, spark)
    hist = stumps.histogram(rows, {"0": stumps.Booster()}, edges, {"0": None})
    best = stumps.best_splits(hist)
    return best.select("feature", "bin", F.round("p_left", 6).alias("p_left"),
                       F.round("p_right", 6).alias("p_right"), F.round("gain", 6).alias("gain"))


@register("h3_adaboost_round1", SQL_STUMP + """
SELECT CAST(best.f AS INTEGER) AS feature, best.b AS bin, round(err, 6) AS err,
       round(ln((1 - err) / err), 6) AS alpha FROM best, er""")
def h3_adaboost_round1(spark, sf):
    _, m = _round1(spark, sf)
    st = m.stumps[0]
    # the model comes from Spark jobs over the whole table; one row reports it
    return spark.createDataFrame(
        [(st.feature, st.bin, round(m.errors[0], 6), round(m.alphas[0], 6))],
        "feature int, bin int, err double, alpha double")


@register("h4_stump_predict", SQL_STUMP + """
SELECT id, CAST(h AS INTEGER) AS pred,
       round(1 / (1 + exp(-2 * (CASE WHEN h THEN 1 ELSE -1 END))), 6) AS proba FROM pr""")
def h4_stump_predict(spark, sf):
    v, m = _round1(spark, sf)
    out = stumps.predict_boost(v, {"0": m})
    return out.select("id", "pred", F.round("proba", 6).alias("proba"))


@register("h3_adaboost_fit_predict", None)
def h3_adaboost_fit_predict(spark, sf):
    """50 rounds of SAMME on the whole table; every row scored."""
    v = fx.vec_bin(spark, sf)
    models = stumps.fit_boost(v, n_rounds=50)
    return stumps.predict_boost(v, models).select("id", "label", F.round("proba", 6).alias("proba"), "pred")
