"""Registered queries: one per operator of the inventory, each with its oracle.

Every query reads the driver tables (or what Spark derives from them) in full.
``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbors, resample, scoring, splits
from ..session import materialize
from . import fixtures as fx
from .sqlgen import scorecard_ctes, unpivot

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


H = fx.sql_hash
U = fx.sql_uniform

# ---------------------------------------------------------------------------
# P0 flagship: holdout folds -> under-sample -> k-NN -> score card (long)
# ---------------------------------------------------------------------------

SQL_HOLDOUT_VEC = f"""WITH {fx.SQL_VEC_BIN},
rep AS (SELECT v.*, CAST(g.r AS INTEGER) AS repeat FROM vec_bin v, range(0, 10) g(r)),
hs AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY {H("'holdout'", 'repeat', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY repeat, label) AS nc FROM rep),
folds AS (SELECT repeat, id, features, label,
                 CASE WHEN rk <= round(0.2 * nc) THEN 'test' ELSE 'train' END AS split FROM hs)"""


def holdout_knn_sides(spark: SparkSession, sf_dir: str, repeats: int = 10, only: list[int] | None = None):
    """Test rows and under-sampled training rows of every hold-out repeat (or of ``only`` some).

    Folds and draws are ranked on the narrow ``(repeat, id, label)`` table, so
    the rank shuffles move ids, not vectors (x ``repeats``); the features are
    joined once per side just before the neighbour grid (the scan of the
    vectors is shared by both joins)."""
    v = fx.vec_bin(spark, sf_dir)
    folds = splits.stratified_holdout(v.select("id", "label"), repeats=repeats)
    if only is not None:
        folds = folds.where(F.col("repeat").isin(only))
    train = resample.undersample(folds.filter(F.col("split") == "train"),
                                 member_cols=["repeat"], salt="rus")
    test = folds.filter(F.col("split") == "test")
    feats = v.select("id", "features")
    return test.join(feats, on="id", how="inner"), train.join(feats, on="id", how="inner")


def knn_holdout_scorecard(spark: SparkSession, sf_dir: str, only: list[int] | None = None) -> DataFrame:
    test, train = holdout_knn_sides(spark, sf_dir, only=only)
    nb = neighbors.knn(test, train, 5, key_cols=["repeat"])
    pred = neighbors.knn_predict(nb, ["repeat"]).join(
        test.select("repeat", F.col("id").alias("qid"), "label"), on=["repeat", "qid"])
    pred = materialize(pred, "knn-predictions")  # one row per test row; read by every score-card branch
    card = scoring.scorecard_long(pred, ["repeat"])
    return card.select(F.col("repeat").alias("test_number"), "metric", "value")


SQL_KNN_HOLDOUT = SQL_HOLDOUT_VEC + f""",
tr0 AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY {H("'rus'", 'repeat', 'id')}, id) AS rk,
               count(*) OVER (PARTITION BY repeat, label) AS nc FROM folds WHERE split = 'train'),
tr1 AS (SELECT *, min(nc) OVER (PARTITION BY repeat) AS nmin FROM tr0),
tr AS (SELECT repeat, id, features, label FROM tr1 WHERE rk <= nmin),
te AS (SELECT repeat, id, features, label FROM folds WHERE split = 'test'),
pairs AS (SELECT te.repeat, te.id AS qid, te.label AS y, tr.id AS tid, tr.label AS tl,
                 list_sum(list_transform(list_zip(te.features, tr.features), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
          FROM te JOIN tr ON te.repeat = tr.repeat),
nb AS (SELECT *, row_number() OVER (PARTITION BY repeat, qid ORDER BY d2, tid) AS r FROM pairs),
pp AS (SELECT repeat, qid, any_value(y) AS label, avg(tl::DOUBLE) AS proba,
              CAST(avg(tl::DOUBLE) > 0.5 AS INTEGER) AS pred
       FROM nb WHERE r <= 5 GROUP BY repeat, qid),
{scorecard_ctes('pp', 'repeat')}
{unpivot('sc_card', 'repeat AS test_number')}"""

register("knn_holdout_scorecard", SQL_KNN_HOLDOUT)(knn_holdout_scorecard)


from . import catalog_prep  # noqa: E402,F401  (registers on import)
from . import catalog_eval  # noqa: E402,F401
from . import catalog_text  # noqa: E402,F401
from . import catalog_metric  # noqa: E402,F401
from . import catalog_boost  # noqa: E402,F401
from . import catalog_ens  # noqa: E402,F401


def g2_knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 alone: uniform vote of the 5 nearest under-sampled training rows."""
    test, train = holdout_knn_sides(spark, sf_dir)
    nb = neighbors.knn(test, train, 5, key_cols=["repeat"])
    pred = neighbors.knn_predict(nb, ["repeat"])
    return pred.select("repeat", "qid", F.round("proba", 6).alias("proba"), "pred")


register("g2_knn_vote", SQL_KNN_HOLDOUT.split(",\nsc_cf AS")[0] +
         "\nSELECT repeat, qid, round(proba, 6) AS proba, pred FROM pp")(g2_knn_vote)


from . import catalog_experiment  # noqa: E402,F401  (uses the queries above)
