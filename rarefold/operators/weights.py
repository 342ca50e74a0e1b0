"""Class statistics and weights (E1-E5). Class tables have one row per class,
so windows over them are bounded by the number of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_softmax_at


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def top_classes(df: DataFrame, label_col: str = "label", k: int = 2) -> DataFrame:
    """The k most frequent classes (top-k report; ties by label)."""
    return class_counts(df, label_col).orderBy(F.desc("n"), label_col).limit(k)


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Inverse-frequency weight per class, keyed by label, and the same
    normalised to sum to one."""
    c = class_counts(df, label_col).withColumn("weight", 1.0 / F.col("n"))
    return c.withColumn("weight_norm", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def weighted_ce(df: DataFrame, weights: DataFrame, label_col: str = "label",
                logits_col: str = "logits", weight_col: str = "weight_norm") -> DataFrame:
    """sum_i w_yi * (-log softmax(z_i)[y_i]) / sum_i w_yi (class-weighted
    cross-entropy, mean reduction)."""
    w = weights.select(label_col, F.col(weight_col).alias("_w"))
    d = df.join(F.broadcast(w), on=label_col, how="inner")  # one row per class
    nll = -log_softmax_at(F.col(logits_col), F.col(label_col))
    return d.agg((F.sum(F.col("_w") * nll) / F.sum("_w")).alias("loss"),
                 F.avg(nll).alias("loss_unweighted"))


def profile(df: DataFrame, label_col: str = "label") -> DataFrame:
    """E5: positives, negatives and the imbalance ratio neg/pos."""
    y = F.col(label_col)
    return df.agg(F.count_if(y == 1).cast("bigint").alias("n_pos"),
                  F.count_if(y != 1).cast("bigint").alias("n_neg")).withColumn(
        "ratio", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")))
