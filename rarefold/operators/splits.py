"""Train/test folds (C1-C5), seeded and partition-independent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import hash_hex
from .rank import dist_rank, sorted_ordinal

DEFAULT_SEED = 42
BROADCAST_GROUPS = 100_000       # groups whose ordinals go to every task instead of the rows to the groups


# ---- C1: leave one group out ------------------------------------------------

def logo_assign(df: DataFrame, group_col: str = "grp", out: str = "fold") -> DataFrame:
    """Each row gets the fold in which it is the test set: the ordinal of its
    group in sorted name order. Fold *i* trains on every row with ``fold != i``,
    so the N-fold expansion is never materialised (a filter reads it, and a
    table written partitioned by ``fold`` is pruned by it)."""
    # one row per group (file); the group list is the fold list
    ordinal, n = sorted_ordinal(df.select(group_col).where(F.col(group_col).isNotNull()).distinct(), group_col, out)
    return df.join(F.broadcast(ordinal) if n <= BROADCAST_GROUPS else ordinal, on=group_col, how="inner")


def logo_fold(assigned: DataFrame, i: int, fold_col: str = "fold") -> DataFrame:
    """Rows of fold ``i`` with ``split`` = test for group ``i``, else train."""
    return assigned.withColumn(
        "split", F.when(F.col(fold_col) == i, "test").otherwise("train"))


def logo_fold_stats(assigned: DataFrame, label_col: str = "label",
                    group_col: str = "grp", fold_col: str = "fold") -> DataFrame:
    """Per fold: train/test sizes and positives, from group totals (no expansion)."""
    per = assigned.groupBy(fold_col, group_col).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sum(F.col(label_col).cast("bigint")).alias("pos_test"))
    # totals as scalar subqueries: two numbers, no window over all groups
    n = assigned.select(F.count(F.lit(1))).scalar()
    pos = assigned.select(F.sum(F.col(label_col).cast("bigint"))).scalar()
    return per.select(
        fold_col, group_col, (n - F.col("n_test")).alias("n_train"), "n_test",
        (pos - F.col("pos_test")).alias("pos_train"), "pos_test")


# ---- C2 / C3 / C5: stratified ---------------------------------------------

def stratified_holdout(df: DataFrame, label_col: str = "label", test_frac: float = 0.2,
                       repeats: int = 10, seed: int = DEFAULT_SEED,
                       id_col: str = "id", salt: str = "holdout") -> DataFrame:
    """Repeated stratified hold-out: in every (repeat, class) the first
    ``round(test_frac * n_class)`` rows by seeded hash are test."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("_h", hash_hex(seed, salt, F.col("repeat"), F.col(id_col)))
    d = dist_rank(d, ["repeat", label_col], "_h", id_col, out="_rk", total="_nc")
    return (d.withColumn("split", F.when(
                F.col("_rk") <= F.round(F.lit(test_frac) * F.col("_nc")), "test")
                .otherwise("train"))
             .drop("_h", "_rk", "_nc"))


def inner_holdout(train: DataFrame, test_frac: float = 0.1, label_col: str = "label", seed: int = DEFAULT_SEED,
                  id_col: str = "id", salt: str = "eval") -> DataFrame:
    """Rows of the train side of every ``repeat``, with ``held_out``: the first
    ``round(test_frac * n_class)`` of each (repeat, class) by seeded hash."""
    d = train.withColumn("_h", hash_hex(seed, salt, F.col("repeat"), F.col(id_col)))
    d = dist_rank(d, ["repeat", label_col], "_h", id_col, out="_rk", total="_nc")
    return d.withColumn("held_out", F.col("_rk") <= F.round(F.lit(test_frac) * F.col("_nc"))).drop("_h", "_rk", "_nc")


def class_halves(df: DataFrame, label_col: str = "label", seed: int = DEFAULT_SEED,
                 id_col: str = "id") -> DataFrame:
    """Split every class 50/50 on its own (test gets ceil(n/2)); ``role`` tells
    whether the row's class is the majority or the minority."""
    d = df.withColumn("_h", hash_hex(seed, "halves", F.col(id_col)))
    d = dist_rank(d, [label_col], "_h", id_col, out="_rk", total="_nc")
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    roles = counts.select(
        label_col,
        F.when(F.row_number().over(Window.orderBy(F.desc("_c"), label_col)) == 1, "majority")
         .when(F.row_number().over(Window.orderBy("_c", label_col)) == 1, "minority")
         .otherwise("other").alias("role"))
    d = d.withColumn("split", F.when(F.col("_rk") <= F.ceil(F.col("_nc") / 2), "test")
                     .otherwise("train"))
    return d.join(F.broadcast(roles), on=label_col, how="inner").drop("_h", "_rk", "_nc")      # a row per class


def oof_folds(df: DataFrame, label_col: str = "label", n_folds: int = 5,
              seed: int = DEFAULT_SEED, id_col: str = "id",
              member_cols: Sequence[str] = ()) -> DataFrame:
    """Stratified out-of-fold assignment: ``oof = (rank - 1) % n_folds`` inside
    each (member, class)."""
    parts = list(member_cols)
    d = df.withColumn("_h", hash_hex(seed, "oof", *[F.col(c) for c in parts], F.col(id_col)))
    d = dist_rank(d, parts + [label_col], "_h", id_col, out="_rk")
    return d.withColumn("oof", ((F.col("_rk") - 1) % n_folds).cast("int")).drop("_h", "_rk")


# ---- C4: random halves ----------------------------------------------------

def random_halves(df: DataFrame, seed: int = DEFAULT_SEED, id_col: str = "id",
                  salt: str = "c4", member_cols: Sequence[str] = ()) -> DataFrame:
    """Unstratified halves: train = first floor(n/2) rows by seeded hash."""
    parts = list(member_cols)
    d = df.withColumn("_h", hash_hex(seed, salt, *[F.col(c) for c in parts], F.col(id_col)))
    d = dist_rank(d, parts, "_h", id_col, out="_rk", total="_n")
    return (d.withColumn("split", F.when(F.col("_rk") <= F.floor(F.col("_n") / 2), "train")
                         .otherwise("valid"))
             .drop("_h", "_rk", "_n"))
