"""Registered queries: evaluation (J1-J6), score-card rows (A10), ledger (K1-K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger, scoring, splits
from . import fixtures as fx
from .catalog import H, register
from ..session import scratch_path
from .sqlgen import scorecard_ctes, sround, unpivot

R6 = lambda c: F.round(c, 6).alias(c)


def _scored_test(spark, sf):
    folds = splits.stratified_holdout(fx.scored(spark, sf).select("id", "label", "proba", "pred"),
                                      repeats=10)
    return folds.filter(F.col("split") == "test")


SQL_SCORED_TEST = f"""WITH {fx.SQL_SCORED},
rep AS (SELECT s.*, CAST(g.r AS INTEGER) AS repeat FROM scored s, range(0, 10) g(r)),
hs AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY {H("'holdout'", 'repeat', 'id')}, id) AS rk,
              count(*) OVER (PARTITION BY repeat, label) AS nc FROM rep),
te AS (SELECT repeat, id, label, pred, proba FROM hs WHERE rk <= round(0.2 * nc)),
{scorecard_ctes('te', 'repeat')}"""


@register("j1_confusion", SQL_SCORED_TEST + "\nSELECT repeat, tn, fp, fn, tp FROM sc_card")
def j1_confusion(spark, sf):
    return scoring.confusion(_scored_test(spark, sf), ["repeat"])


@register("j2_scorecard", SQL_SCORED_TEST + "\nSELECT repeat, " + ", ".join(
    f"round({m}, 6) AS {m}" for m in scoring.SCORE_METRICS) + " FROM sc_card")
def j2_scorecard(spark, sf):
    card = scoring.scorecard_wide(_scored_test(spark, sf), ["repeat"], score_col=None)
    return card.select("repeat", *[R6(m) for m in scoring.SCORE_METRICS])


@register("j3_auc", SQL_SCORED_TEST + "\nSELECT repeat, round(auc, 6) AS auc FROM sc_card")
def j3_auc(spark, sf):
    return scoring.auc(_scored_test(spark, sf), ["repeat"]).select("repeat", R6("auc"))


@register("j4_accuracy", SQL_SCORED_TEST + """
SELECT repeat, round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy FROM te GROUP BY repeat""")
def j4_accuracy(spark, sf):
    return scoring.accuracy(_scored_test(spark, sf), ["repeat"]).select("repeat", R6("accuracy"))


SQL_REPORT = """ev AS (SELECT y AS cls, 1 AS t, CAST(y = p AS INTEGER) AS tp, 0 AS pp FROM pr
             UNION ALL SELECT p AS cls, 0 AS t, 0 AS tp, 1 AS pp FROM pr),
ag AS (SELECT cls, sum(tp)::BIGINT AS tp, sum(pp)::BIGINT AS n_pred, sum(t)::BIGINT AS support FROM ev GROUP BY cls),
rp AS (SELECT *, coalesce(CASE WHEN n_pred <> 0 THEN tp::DOUBLE / n_pred END, 0.0) AS precision,
                 coalesce(CASE WHEN support <> 0 THEN tp::DOUBLE / support END, 0.0) AS recall FROM ag),
rep AS (SELECT *, coalesce(CASE WHEN 4 * precision + recall <> 0
                   THEN 5 * precision * recall / (4 * precision + recall) END, 0.0) AS fbeta FROM rp)"""


@register("j5_per_class_report", f"""WITH e AS (SELECT label AS y, CAST(embedding AS DOUBLE[]) AS features FROM embeddings),
sc AS (SELECT y, {fx.sql_class_scores('features', 10)} AS scores FROM e),
pr AS (SELECT y, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS p FROM sc),
{SQL_REPORT}
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fbeta, 6) AS fbeta, support FROM rep""")
def j5_per_class_report(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    d = e.select(F.col("label").cast("int").alias("label"),
                 S.argmax(fx.class_scores(F.col("embedding").cast("array<double>"), 10)).alias("pred"))
    rep = scoring.per_class_report(d)
    return rep.select("cls", R6("precision"), R6("recall"), R6("fbeta"), "support")


@register("j6_deep_scorecard", f"""WITH {fx.SQL_LOGITS},
pr AS (SELECT label AS y, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS p FROM logits),
{SQL_REPORT}
SELECT round((SELECT avg(CAST(y = p AS DOUBLE)) FROM pr), 6) AS accuracy,
       round(r1.precision, 6) AS precision, round(r1.recall, 6) AS recall,
       round(sqrt(r0.recall * r1.recall), 6) AS gmean,
       round(CASE WHEN r1.precision + r1.recall <> 0
                  THEN 2 * r1.precision * r1.recall / (r1.precision + r1.recall) END, 6) AS f1,
       round(r1.fbeta, 6) AS f2
FROM rep r1, rep r0 WHERE r1.cls = 1 AND r0.cls = 0""")
def j6_deep_scorecard(spark, sf):
    lg = fx.logits(spark, sf)
    d = lg.select("label", S.argmax(F.col("logits")).alias("pred"))
    card = scoring.deep_scorecard(d)
    return card.select(*[R6(c) for c in ("accuracy", "precision", "recall", "gmean", "f1", "f2")])


# ---- leave-one-group-out score cards -> ledger --------------------------------

METRICS = scoring.SCORE_METRICS + ["auc"]
RUNS = [("len_t03", 0.3), ("len_t05", 0.5)]


def _logo_cards(spark, sf):
    """Long score cards of every leave-one-source-out fold for two runs
    (decision thresholds 0.3 and 0.5 on the fixed score)."""
    s = fx.scored(spark, sf).select("id", "grp", "label", "proba")
    runs = None
    for name, thr in RUNS:
        r = s.withColumn("run", F.lit(name)).withColumn("pred", (F.col("proba") > thr).cast("int"))
        runs = r if runs is None else runs.unionByName(r)
    a = splits.logo_assign(runs)
    card = scoring.scorecard_wide(a, ["run", "fold"])
    long = scoring.to_long(card, ["run", "fold"], METRICS)
    return long.select("run", F.col("fold").alias("test_number"), "metric", "value")


def _runs(spark, sf):
    s = fx.scored(spark, sf)
    n = s.agg(F.countDistinct("grp").alias("n_folds"))
    rs = None
    for name, _ in RUNS:
        r = n.withColumn("run", F.lit(name))
        rs = r if rs is None else rs.unionByName(r)
    return rs


def _ledger(spark, sf):
    """Folds whose score card is complete are stored; folds of sources with
    no positive (or no negative) cannot be scored and stay pending."""
    cards = _logo_cards(spark, sf)
    incomplete = cards.filter(F.col("value").isNull()).select("run", "test_number").distinct()
    return cards.join(incomplete, on=["run", "test_number"], how="left_anti")


SQL_LOGO = f"""WITH {fx.SQL_SCORED},
g AS (SELECT grp, CAST(row_number() OVER (ORDER BY grp) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT grp FROM scored)),
r AS (SELECT * FROM (VALUES ('len_t03', 0.3), ('len_t05', 0.5)) t(run, thr)),
src AS (SELECT r.run, g.fold, s.label, CAST(s.proba > r.thr AS INTEGER) AS pred, s.proba
        FROM scored s JOIN g ON s.grp = g.grp, r),
{scorecard_ctes('src', ['run', 'fold'])},
cards AS ({unpivot('sc_card', 'run, fold AS test_number', METRICS)}),
incomplete AS (SELECT DISTINCT run, test_number FROM cards WHERE value IS NULL),
ledger AS (SELECT * FROM cards c WHERE NOT EXISTS (
  SELECT 1 FROM incomplete i WHERE i.run = c.run AND i.test_number = c.test_number)),
runs AS (SELECT r.run, (SELECT count(DISTINCT grp) FROM scored) AS n_folds FROM r)"""


@register("a10_logo_scorecards", SQL_LOGO + "\nSELECT * FROM cards")
def a10_logo_scorecards(spark, sf):
    return _logo_cards(spark, sf)


@register("k1_pending_folds", SQL_LOGO + """,
planned AS (SELECT run, CAST(unnest(range(0, n_folds)) AS INTEGER) AS test_number FROM runs)
SELECT p.run, p.test_number FROM planned p
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.run = p.run AND l.test_number = p.test_number)""")
def k1_pending_folds(spark, sf):
    planned = ledger.run_grid(_runs(spark, sf))
    return ledger.pending(planned, _ledger(spark, sf))


@register("k2_finished_runs", SQL_LOGO + """
SELECT runs.run, m.max_fold, coalesce(m.max_fold = runs.n_folds - 1, false) AS finished
FROM runs LEFT JOIN (SELECT run, max(test_number) AS max_fold FROM ledger GROUP BY run) m ON runs.run = m.run""")
def k2_finished_runs(spark, sf):
    return ledger.finished_runs(_ledger(spark, sf), _runs(spark, sf))


@register("k3_run_grid", SQL_LOGO + """
SELECT run, CAST(unnest(range(0, n_folds)) AS INTEGER) AS test_number FROM runs""")
def k3_run_grid(spark, sf):
    return ledger.run_grid(_runs(spark, sf))


CLASSIFIERS = ["easy", "rusboost", "mlbagging", "mlboosting", "mlstacking", "mlboostacking"]


@register("k3_experiment_grid", f"""WITH {fx.SQL_TEXT_BIN},
d AS (SELECT grp AS embedding, count(*)::BIGINT AS n_folds FROM text_bin GROUP BY grp)
SELECT c.classifier, embedding, c.classifier || '_' || embedding AS run, CAST(unnest(range(0, n_folds)) AS INTEGER) AS test_number
FROM d, (VALUES {", ".join(f"('{c}')" for c in CLASSIFIERS)}) c(classifier)""")
def k3_experiment_grid(spark, sf):
    """Classifier x embedding x fold, with the shallow run names of B4: a source
    stands for an embedding, and has a fold per document."""
    d = fx.text_bin(spark, sf).groupBy(F.col("grp").alias("embedding")).agg(F.count("*").alias("n_folds"))
    runs = ledger.experiment_runs(CLASSIFIERS, d)
    return runs.join(ledger.run_grid(runs), on="run").select("classifier", "embedding", "run", "test_number")


@register("l5_select_best_epoch", SQL_LOGO + """
SELECT test_number AS best_epoch, round(1 - value, 6) AS eval_loss
FROM ledger WHERE metric = 'f1' AND value IS NOT NULL ORDER BY eval_loss, best_epoch LIMIT 1""")
def l5_select_best_epoch(spark, sf):
    """L5's choice over a metrics table: score cards in the place of epochs."""
    from ..operators import textclf
    h = _ledger(spark, sf).filter("metric = 'f1' and value is not null")
    return textclf.select_best(h.select(F.col("test_number").alias("epoch"), F.round(1 - F.col("value"), 6).alias("eval_loss")))


@register("k4_summary", SQL_LOGO + """
SELECT run, metric, """ + sround("avg(value)") + " AS avg, " + sround("stddev_samp(value)") + """ AS stddev
FROM ledger GROUP BY run, metric ORDER BY run, metric""")
def k4_summary(spark, sf):
    s = ledger.summary(_ledger(spark, sf))
    return s.select("run", "metric", R6("avg"), R6("stddev"))


@register("a9_ledger_append", SQL_LOGO + "\nSELECT run, test_number, metric, value FROM ledger")
def a9_ledger_append(spark, sf):
    """Score cards appended to a parquet ledger, then appended again as a
    re-run would: partitions (run, test_number) are overwritten, not doubled."""
    path = scratch_path(spark, "ledger")
    cards = _ledger(spark, sf)
    ledger.append(cards, path)
    ledger.append(cards, path)
    return ledger.read(spark, path).select("run", "test_number", "metric", "value")
