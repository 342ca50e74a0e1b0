"""Registered queries: whole experiments. Planned folds that the ledger lacks
are fitted (as members of the same jobs), scored, appended to the ledger, and
the ledger is summarised. Every experiment takes the ``path`` of a ledger to go
on with; without one it starts a fresh ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensembles, ledger, logo, resample, scoring, splits, stumps, textclf
from ..operators.blocks import matrix
from ..session import materialize, release, row_join, scratch_path
from . import fixtures as fx
from .catalog import SQL_KNN_HOLDOUT, knn_holdout_scorecard, register
from .catalog_prep import SQL_PAIRED, a1_paired_lines
from .catalog_text import N_FEATURES, SPLIT, text_folds
from .sqlgen import scorecard_ctes, sround, unpivot

REPEATS = 10


def run_experiment(spark, run: str, n_folds: int, score: Callable[[list[int]], DataFrame], path: str | None = None) -> DataFrame:
    """Summary of one run. ``score(folds)`` fits the given folds only and returns
    their long score cards (``test_number, metric, value``). It gets the planned
    folds that the ledger at ``path`` (default: a fresh one) lacks, and is not
    called when there are none."""
    path = path or scratch_path(spark, "experiment")
    runs = spark.range(1).select(F.lit(run).alias("run"), F.lit(n_folds).alias("n_folds"))
    todo = ledger.pending(ledger.run_grid(runs), ledger.read(spark, path))
    folds = sorted(r[0] for r in todo.select("test_number").collect())      # n_folds numbers at most
    if folds:
        ledger.append(score(folds).withColumn("run", F.lit(run)).select("run", "test_number", "metric", "value"), path)
    done = ledger.read(spark, path).where(F.col("run") == run)
    finished = ledger.finished_runs(done, runs).filter("finished").select("run")
    # to 12 digits first: the order of a sum must not tip a half of the last digit
    s = ledger.summary(done.join(F.broadcast(finished), on="run", how="left_semi"))
    return s.select("run", "metric", *[F.round(F.round(c, 12), 6).alias(c) for c in ("avg", "stddev")])


@register("experiment_knn", f"""SELECT 'knn_vec' AS run, metric, {sround("avg(value)")} AS avg,
  {sround("stddev_samp(value)")} AS stddev FROM ({SQL_KNN_HOLDOUT}) GROUP BY metric""")
def experiment_knn(spark, sf, path=None):
    """10 hold-out folds -> under-sample -> k-NN -> score cards -> ledger -> summary."""
    return run_experiment(spark, "knn_vec", REPEATS, lambda folds: knn_holdout_scorecard(spark, sf, folds), path)


def _predict_folds(test: DataFrame, models: dict[str, stumps.Booster]) -> DataFrame:
    """Mean P(1) of the members ``fold:bag`` of each row's own fold."""
    bc = test.sparkSession.sparkContext.broadcast(models)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        for m, model in bc.value.items():
            own.setdefault(m.split(":")[0], []).append(model)
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X, fold = matrix(t, "features"), t.column("repeat").to_numpy()
            p = np.zeros(t.num_rows)
            for f in np.unique(fold):
                s = fold == f
                p[s] = np.mean([1.0 / (1.0 + np.exp(-stumps.decision(m, X[s]))) for m in own[str(f)]], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p > 0.5).astype(np.int32))],
                                             names=["repeat", "label", "proba", "pred"])

    return test.select("repeat", "label", "features").mapInArrow(fn, "repeat int, label int, proba double, pred int")


def _fold_rows(spark, sf, folds: list[int]):
    """The vectors and the given hold-out folds of them (written: ids only)."""
    v = fx.vec_bin(spark, sf)
    sides = splits.stratified_holdout(v.select("id", "label"), repeats=REPEATS)
    sides = sides.where(F.col("repeat").isin(folds)).withColumn("repeat", F.col("repeat").cast("int"))
    return v.select("id", "features"), materialize(sides, "experiment-folds")


def _cards(pred: DataFrame, sides: DataFrame) -> DataFrame:
    """Score cards of (repeat, label, proba, pred) rows, which are written first."""
    pred = materialize(pred, "experiment-predictions")
    release(sides)
    return scoring.scorecard_long(pred, ["repeat"]).select(F.col("repeat").alias("test_number"), "metric", "value")


@register("experiment_easy_ensemble", None)
def experiment_easy_ensemble(spark, sf, path=None):
    """10 hold-out folds x 10 under-sampled bags x 50 stumps, trained as 100
    members of the same jobs -> score cards -> ledger -> summary."""
    def score(folds: list[int]) -> DataFrame:
        v, sides = _fold_rows(spark, sf, folds)
        bags = sides.filter("split = 'train'").withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(9))))
        bags = resample.undersample(bags.select("repeat", "bag", "id", "label"), salt="bag", member_cols=["repeat", "bag"])
        bags = row_join(bags.withColumn("member", F.concat_ws(":", "repeat", "bag")), v, "id")
        models = stumps.fit_boost(bags, 50, member_col="member")
        return _cards(_predict_folds(row_join(sides.filter("split = 'test'"), v, "id"), models), sides)
    return run_experiment(spark, "easy_vec", REPEATS, score, path)


@register("experiment_mlbagging", None)
def experiment_mlbagging(spark, sf, path=None):
    """10 hold-out folds x 10 balanced bootstrap bags: the maps of all 100 members
    from one LMNN fit, k-NN per member in one search -> score cards -> ledger."""
    def score(folds: list[int]) -> DataFrame:
        v, sides = _fold_rows(spark, sf, folds)
        pred = ensembles.mlbagging_folds(sides, v)
        return _cards(row_join(pred, sides.select("repeat", F.col("id").alias("qid"), "label"), ["repeat", "qid"]), sides)
    return run_experiment(spark, "mlbagging_vec", REPEATS, score, path)


@register("experiment_rusboost", None)
def experiment_rusboost(spark, sf, path=None):
    """10 hold-out folds x 50 rounds of SAMME.R on under-samples, the folds as
    members of the same jobs -> score cards -> ledger -> summary."""
    def score(folds: list[int]) -> DataFrame:
        v, sides = _fold_rows(spark, sf, folds)
        models = ensembles.rusboost_folds(sides.filter("split = 'train'"), v)
        return _cards(_predict_folds(row_join(sides.filter("split = 'test'"), v, "id"), models), sides)
    return run_experiment(spark, "rusboost_vec", REPEATS, score, path)


@register("experiment_mlboosting", None)
def experiment_mlboosting(spark, sf, path=None):
    """As experiment_rusboost with LMNN -> stump: the maps of all folds and
    rounds come from one LMNN fit."""
    def score(folds: list[int]) -> DataFrame:
        v, sides = _fold_rows(spark, sf, folds)
        models = ensembles.rusboost_folds(sides.filter("split = 'train'"), v, n_rounds=10, metric=True)
        return _cards(_predict_folds(row_join(sides.filter("split = 'test'"), v, "id"), models), sides)
    return run_experiment(spark, "mlboosting_vec", REPEATS, score, path)


DEEP_METRICS = ["precision", "recall", "gmean", "f1", "f2"]


def _text_experiment(variant: str):
    def experiment(spark, sf, path=None):
        def score(folds: list[int]) -> DataFrame:
            own = text_folds(spark, sf, variant, folds)
            pred = materialize(own.predict(own.fit(variant)), "experiment-predictions")
            release(own.table)
            card = scoring.deep_scorecard(pred, ["repeat"])
            return scoring.to_long(card, ["repeat"], DEEP_METRICS).withColumnRenamed("repeat", "test_number")
        return run_experiment(spark, f"text_{variant}", REPEATS, score, path)
    experiment.__doc__ = f"10 hold-out folds of the text classifier '{variant}' -> deep score cards -> ledger -> summary."
    return experiment


for _v in textclf.VARIANTS:
    register(f"experiment_text_{_v}", None)(_text_experiment(_v))


# ---- leave one group out, end to end ----------------------------------------------

# the paired lines as one more table of the same statement
_AT = SQL_PAIRED.index("SELECT 'doc'")
SQL_LOGO_NB = f"""{SQL_PAIRED[:_AT].rstrip()},
paired AS ({SQL_PAIRED[_AT:]}),
src AS (SELECT p.file || ':' || p.line_no AS id, t.grp, p.text, p.label FROM paired p JOIN text_bin t ON p.file = 'doc' || t.id),
gr AS (SELECT grp, CAST(row_number() OVER (ORDER BY grp) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT grp FROM src)),
r AS (SELECT src.id, gr.fold, src.text, src.label FROM src JOIN gr ON src.grp = gr.grp),
tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda t: t <> '')) AS t FROM r),
tf AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {N_FEATURES} AS INTEGER) AS term, count(*) AS tf FROM tok GROUP BY id, term),
f AS (SELECT DISTINCT fold FROM r),
lf AS (SELECT tf.term, tf.tf, r.fold, r.label FROM tf JOIN r ON tf.id = r.id),
-- every fold's training side, read in full
th AS (SELECT f.fold, lf.term, sum(CASE WHEN label = 1 THEN tf ELSE 0 END) + 1 AS c1, sum(CASE WHEN label = 0 THEN tf ELSE 0 END) + 1 AS c0
       FROM f JOIN lf ON f.fold <> lf.fold GROUP BY f.fold, lf.term),
nn AS (SELECT f.fold, coalesce(sum(CASE WHEN label = 1 THEN tf END), 0) + {N_FEATURES} AS n1,
              coalesce(sum(CASE WHEN label = 0 THEN tf END), 0) + {N_FEATURES} AS n0 FROM f LEFT JOIN lf ON f.fold <> lf.fold GROUP BY f.fold),
pr AS (SELECT f.fold, count(*) FILTER (label = 1) AS d1, count(*) FILTER (label = 0) AS d0 FROM f JOIN r ON f.fold <> r.fold GROUP BY f.fold),
sc AS (SELECT r.id, r.fold, r.label, coalesce(sum(tf.tf * (ln(coalesce(th.c1, 1) / coalesce(th.c0, 1)) + ln(nn.n0 / nn.n1))), 0) AS s
       FROM r JOIN nn ON r.fold = nn.fold LEFT JOIN tf ON r.id = tf.id LEFT JOIN th ON th.fold = r.fold AND th.term = tf.term
       GROUP BY r.id, r.fold, r.label),
od AS (SELECT sc.id, sc.fold, sc.label, round(CASE WHEN d1 > 0 AND d0 > 0 THEN greatest(least(ln(d1 / d0) + s, 700.0), -700.0) END, 9) AS o
       FROM sc JOIN pr ON sc.fold = pr.fold),
nb AS (SELECT id, fold, label, 1 / (1 + exp(-o)) AS proba, CAST(o > 0 AS INTEGER) AS pred FROM od)"""


def logo_lines(spark, sf):
    """A1 -> C1: lines paired with labels, each line's fold the one of its source."""
    t = fx.text_bin(spark, sf)
    lines = a1_paired_lines(spark, sf).withColumn("id", F.concat_ws(":", "file", "line_no"))
    of = t.select(F.concat(F.lit("doc"), F.col("id").cast("string")).alias("file"), "grp")
    # written: the groups are numbered from them before they are read
    return splits.logo_assign(materialize(lines.join(of, "file").select("id", "grp", "text", "label"), "logo-lines"))


@register("c1_logo_naive_bayes", SQL_LOGO_NB + """
SELECT fold, id, label, round(proba, 6) AS proba, pred FROM nb""")
def c1_logo_naive_bayes(spark, sf):
    """Every line by the model of all other sources, from totals minus the source's own counts."""
    out = logo.naive_bayes(logo_lines(spark, sf), N_FEATURES)
    return out.select("fold", "id", "label", F.round("proba", 6).alias("proba"), "pred")


@register("experiment_logo", SQL_LOGO_NB + f""",
{scorecard_ctes('nb', 'fold')},
cards AS ({unpivot('sc_card', 'fold AS test_number')})
SELECT 'logo_nb' AS run, metric, {sround("avg(value)")} AS avg, {sround("stddev_samp(value)")} AS stddev FROM cards GROUP BY metric""")
def experiment_logo(spark, sf, path=None):
    """Paired lines (A1) -> a fold per group (C1) -> fold sink (A7) -> loader (A5)
    -> naive Bayes of all folds from complements -> score cards -> ledger -> summary."""
    lines = logo_lines(spark, sf)
    folds = scratch_path(spark, "logo-folds")
    lines.withColumn("split", F.lit("test")).write.partitionBy("fold").parquet(folds)
    n = spark.read.parquet(folds).select("fold").distinct().count()

    def score(todo: list[int]) -> DataFrame:
        # a fold's test side is its partition, its training side all the others
        pred = materialize(logo.naive_bayes(spark.read.parquet(folds), N_FEATURES).where(F.col("fold").isin(todo)), "logo-predictions")
        return scoring.scorecard_long(pred, ["fold"]).withColumnRenamed("fold", "test_number")
    return run_experiment(spark, "logo_nb", n, score, path)
