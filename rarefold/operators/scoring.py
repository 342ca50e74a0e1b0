"""Imbalance-aware evaluation (J1-J6) as grouped aggregates.

Undefined ratios (zero denominators) are NULL, not NaN or an error, so a fold
without positives scores to NULL and does not poison a mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SCORE_METRICS = ["gmean", "tpr", "tnr", "precision", "recall", "f1", "f2"]


def _div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def _keyed(df: DataFrame, key_cols: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """Keyless calls get a constant key so that every join is an equi-join."""
    if key_cols:
        return df, list(key_cols), False
    return df.withColumn("_k0", F.lit(0)), ["_k0"], True


def confusion(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
              pred_col: str = "pred") -> DataFrame:
    """Tn, fp, fn, tp per key (binary 0/1)."""
    y, p = F.col(label_col), F.col(pred_col)
    c = lambda cond: F.count_if(cond).cast("bigint")
    return df.groupBy(*key_cols).agg(
        c((y == 0) & (p == 0)).alias("tn"), c((y == 0) & (p == 1)).alias("fp"),
        c((y == 1) & (p == 0)).alias("fn"), c((y == 1) & (p == 1)).alias("tp"))


def scorecard(conf: DataFrame) -> DataFrame:
    """The score card. When negatives do not outnumber positives the two
    rates swap (as the reference defines it); precision stays class 1's."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rate_pos = _div(tp, fn + tp)
    rate_neg = _div(tn, tn + fp)
    more_neg = (tn + fp) > (fn + tp)
    d = (conf.withColumn("tpr", F.when(more_neg, rate_pos).otherwise(rate_neg))
         .withColumn("tnr", F.when(more_neg, rate_neg).otherwise(rate_pos))
         .withColumn("precision", _div(tp, tp + fp))
         .withColumn("recall", F.col("tpr")))
    p, r = F.col("precision"), F.col("recall")
    return (d.withColumn("gmean", F.sqrt(F.col("tpr") * F.col("tnr")))
            .withColumn("f1", _div(2 * p * r, p + r))
            .withColumn("f2", _div(5 * p * r, 4 * p + r)))


def score_table(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
                pred_col: str = "pred", score_col: str = "proba") -> DataFrame:
    """Predictions collapsed to ``(key, score, pred) -> pos, neg``: the one
    pass over the rows that both the confusion matrix and the AUC read."""
    y = F.col(label_col).cast("bigint")
    return df.groupBy(*key_cols, score_col, pred_col).agg(
        F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))


def _confusion_from(st: DataFrame, keys: list[str], pred_col: str) -> DataFrame:
    p = F.col(pred_col)
    s = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    return st.groupBy(*keys).agg(
        s(p == 0, "_neg").alias("tn"), s(p == 1, "_neg").alias("fp"),
        s(p == 0, "_pos").alias("fn"), s(p == 1, "_pos").alias("tp"))


def _auc_from(st: DataFrame, keys: list[str], score_col: str) -> DataFrame:
    per_score = st.groupBy(*keys, score_col).agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    # dealt by ranges of (key, score) and written with the range's number, which is
    # then the same for every reader: numbers rise with the score within a key
    d = materialize(per_score.where(F.col(score_col).isNotNull()).repartitionByRange(*keys, score_col).withColumn("_bk", F.spark_partition_id()), "score-ranges")
    per_bucket = d.groupBy(*keys, "_bk").agg(F.sum("_neg").alias("_bn"))      # ranges per key at most
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_bucket.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn")
    # ranges are consecutive, so there are at most keys + ranges rows
    d = d.join(F.broadcast(offs), on=keys + ["_bk"], how="inner")
    local = Window.partitionBy(*keys, "_bk").orderBy(score_col).rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.withColumn("_below", F.col("_off") + F.coalesce(F.sum("_neg").over(local), F.lit(0)))
    d = d.withColumn("_c", F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    agg = d.groupBy(*keys).agg(F.sum("_c").alias("_s"), F.sum("_pos").alias("_P"),
                               F.sum("_neg").alias("_N"))
    return agg.select(*keys, _div(F.col("_s"), F.col("_P") * F.col("_N")).alias("auc"))


def auc(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
        score_col: str = "proba") -> DataFrame:
    """ROC-AUC with ties counted half, per key; rows without a score are left out.

    Rows collapse to distinct scores first, which are sorted by Spark's range
    partitioning; the running count of negatives below each score is then taken
    inside its range (offsets over a row per key and range), never over a whole key
    in one task.
    """
    df, keys, tmp = _keyed(df, key_cols)
    y = F.col(label_col).cast("bigint")
    st = df.groupBy(*keys, score_col).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    out = _auc_from(st, keys, score_col)
    return out.drop("_k0") if tmp else out


def scorecard_wide(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
                   pred_col: str = "pred", score_col: str | None = "proba") -> DataFrame:
    """J1 + J2 (+ J3) per key from a single aggregation of the predictions."""
    df, keys, tmp = _keyed(df, key_cols)
    cols = list(key_cols) + SCORE_METRICS
    if score_col is None:
        return scorecard(confusion(df, keys, label_col, pred_col)).select(*cols)
    st = score_table(df, keys, label_col, pred_col, score_col)
    card = scorecard(_confusion_from(st, keys, pred_col))
    card = card.join(_auc_from(st, keys, score_col), on=keys, how="left")
    return card.select(*cols, "auc")


def to_long(card: DataFrame, key_cols: Sequence[str], metrics: Sequence[str],
            digits: int | None = 6) -> DataFrame:
    """A10: one row per (key, metric)."""
    vals = [F.col(m).cast("double").alias(m) for m in metrics]
    long = card.select(*key_cols, *vals).unpivot(list(key_cols), list(metrics), "metric", "value")
    if digits is not None:
        long = long.withColumn("value", F.round("value", digits))
    return long


def scorecard_long(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
                   pred_col: str = "pred", score_col: str | None = "proba") -> DataFrame:
    metrics = SCORE_METRICS + (["auc"] if score_col else [])
    return to_long(scorecard_wide(df, key_cols, label_col, pred_col, score_col),
                   key_cols, metrics)


# ---- J4-J6: multi-class report and the deep score card -------------------

def accuracy(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
             pred_col: str = "pred") -> DataFrame:
    return df.groupBy(*key_cols).agg(
        F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"))


def per_class_report(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
                     pred_col: str = "pred", beta: float = 2.0) -> DataFrame:
    """Per class precision, recall, F-beta and support for any number of
    classes; a zero denominator gives 0 (the library's convention)."""
    keys = list(key_cols)
    y, p = F.col(label_col), F.col(pred_col)
    ev = df.select(*keys, F.explode(F.array(
        F.struct(y.alias("cls"), F.lit(1).alias("t"), (y == p).cast("int").alias("tp"),
                 F.lit(0).alias("pp")),
        F.struct(p.alias("cls"), F.lit(0).alias("t"), F.lit(0).alias("tp"),
                 F.lit(1).alias("pp")))).alias("e")).select(*keys, "e.*")
    agg = ev.groupBy(*keys, "cls").agg(
        F.sum("tp").cast("bigint").alias("tp"), F.sum("pp").cast("bigint").alias("n_pred"),
        F.sum("t").cast("bigint").alias("support"))
    z = lambda num, den: F.coalesce(_div(num, den), F.lit(0.0))
    b2 = beta * beta
    agg = (agg.withColumn("precision", z(F.col("tp"), F.col("n_pred")))
           .withColumn("recall", z(F.col("tp"), F.col("support"))))
    pr, rc = F.col("precision"), F.col("recall")
    return agg.withColumn("fbeta", z((1 + b2) * pr * rc, b2 * pr + rc)).select(
        *keys, "cls", "precision", "recall", "fbeta", "support")


def deep_scorecard(df: DataFrame, key_cols: Sequence[str] = (), label_col: str = "label",
                   pred_col: str = "pred") -> DataFrame:
    """Accuracy, class-1 precision/recall, gmean = sqrt(rec0 * rec1),
    f1 (NULL when 0/0) and f2 of class 1."""
    df, keys, tmp = _keyed(df, key_cols)
    rep = per_class_report(df, keys, label_col, pred_col)
    one = rep.filter(F.col("cls") == 1).select(*keys, "precision", "recall",
                                               F.col("fbeta").alias("f2"))
    zero = rep.filter(F.col("cls") == 0).select(*keys, F.col("recall").alias("_rec0"))
    acc = accuracy(df, keys, label_col, pred_col)
    out = acc.join(one, on=keys, how="left").join(zero, on=keys, how="left")
    p, r = F.col("precision"), F.col("recall")
    return out.select(*list(key_cols), "accuracy", "precision", "recall",
                      F.sqrt(F.col("_rec0") * r).alias("gmean"),
                      _div(2 * p * r, p + r).alias("f1"), "f2")
