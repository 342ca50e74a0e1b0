"""Experiments fit the pending folds only, and go on from a half-filled ledger."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from rarefold.operators import ensembles, ledger, lmnn, stumps, textclf
from rarefold.plans import catalog_experiment as ex
from rarefold.session import scratch_path


def _cards(spark, folds, value=1.0):
    return spark.createDataFrame([(f, "f1", value) for f in folds], "test_number int, metric string, value double")


def test_only_pending_folds_are_fitted(spark):
    path, asked = scratch_path(spark, "half"), []
    ledger.append(_cards(spark, [0, 2, 3], 0.5).withColumn("run", F.lit("r")), path)
    ledger.append(_cards(spark, [1], 9.0).withColumn("run", F.lit("other")), path)

    def score(folds):
        asked.append(folds)
        return _cards(spark, folds)

    first = ex.run_experiment(spark, "r", 5, score, path).collect()
    assert asked == [[1, 4]] and [(r.run, r.metric, r.avg) for r in first] == [("r", "f1", 0.7)]
    again = ex.run_experiment(spark, "r", 5, score, path).collect()
    assert asked == [[1, 4]] and again == first          # nothing left: nothing is fitted


def test_half_filled_ledger_counts_fitted_members(spark, monkeypatch):
    path = scratch_path(spark, "half")
    done = list(range(8))
    members = {}
    for run, mod, name in (("easy_vec", stumps, "fit_boost"), ("text_plain", textclf, "train")):
        ledger.append(_cards(spark, done).withColumn("run", F.lit(run)), path)
        plain = getattr(mod, name)

        def counted(*a, run=run, plain=plain, **k):
            out = plain(*a, **k)
            members[run] = len(out)
            return out

        monkeypatch.setattr(mod, name, counted)
    ex.experiment_easy_ensemble(spark, SF, path).collect()
    from rarefold.plans.catalog import QUERIES
    QUERIES["experiment_text_plain"][0](spark, SF, path).collect()
    assert members == {"easy_vec": 2 * 10, "text_plain": 2}       # folds 8 and 9 only


def test_knn_experiment_goes_on_to_the_same_summary(spark):
    whole = sorted(ex.experiment_knn(spark, SF).collect())
    path = scratch_path(spark, "half")
    cards = ex.knn_holdout_scorecard(spark, SF, [0, 1, 2])
    ledger.append(cards.withColumn("run", F.lit("knn_vec")), path)
    assert sorted(ex.experiment_knn(spark, SF, path).collect()) == whole
