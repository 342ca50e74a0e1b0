"""Resampling (R1-R8): under-sampling, balanced bootstrap, weighted draws.

Every draw is an equi-join on a rank (no range join, no collect): rows get a
dense 0-based index inside their key by the distributed rank, and each draw
computes the index it wants from a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import hash_hex, uniform
from ..session import materialize, row_join
from .rank import dist_rank
from .splits import DEFAULT_SEED


def _targets(counts: DataFrame, member_cols: list[str], label_col: str,
             strategy) -> DataFrame:
    """Per (member, class) the number of rows to keep."""
    wm = Window.partitionBy(*member_cols)
    c = counts.withColumn("_nmin", F.min("_nc").over(wm))
    if strategy == "auto" or strategy is None:
        keep = F.col("_nmin")
    elif isinstance(strategy, float):
        # ratio = n_minority / n_class_after: every non-minority class shrinks
        keep = F.when(F.col("_nc") == F.col("_nmin"), F.col("_nc")).otherwise(
            F.least(F.col("_nc"), F.floor(F.col("_nmin") / F.lit(strategy))))
    elif isinstance(strategy, dict):
        keep = F.col("_nc")
        for lab, n in strategy.items():
            keep = F.when(F.col(label_col) == F.lit(lab), F.least(F.col("_nc"), F.lit(n))).otherwise(keep)
    else:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    return c.withColumn("_keep", keep.cast("bigint")).drop("_nmin")


def undersample(df: DataFrame, label_col: str = "label", seed: int = DEFAULT_SEED,
                salt: str = "rus", id_col: str = "id", member_cols: Sequence[str] = (),
                strategy="auto") -> DataFrame:
    """The kept rows of ``undersample_flag``."""
    return (undersample_flag(df, label_col, seed, salt, id_col, member_cols, strategy)
            .filter("_in").drop("_in"))


def undersample_flag(df: DataFrame, label_col: str = "label", seed: int = DEFAULT_SEED,
                     salt: str = "rus", id_col: str = "id", member_cols: Sequence[str] = (),
                     strategy="auto") -> DataFrame:
    """Random under-sampling without replacement inside each member:
    every class keeps its first ``target`` rows by seeded hash ('auto': the
    size of the smallest class)."""
    members = list(member_cols)
    d = df.withColumn("_h", hash_hex(seed, salt, *[F.col(c) for c in members], F.col(id_col)))
    d = dist_rank(d, members + [label_col], "_h", id_col, out="_rk", total="_nc")
    counts = d.select(*members, label_col, "_nc").distinct()
    tgt = _targets(counts, members, label_col, strategy).drop("_nc")
    # one row per (member, class), both given by the configuration: no row of the
    # table is shuffled by its label
    return (d.join(F.broadcast(tgt), on=members + [label_col], how="inner")
             .withColumn("_in", F.col("_rk") <= F.col("_keep"))
             .drop("_h", "_rk", "_nc", "_keep"))


def easy_bags(df: DataFrame, n_bags: int = 10, label_col: str = "label",
              seed: int = DEFAULT_SEED, id_col: str = "id", salt: str = "bag") -> DataFrame:
    """``n_bags`` independent under-samples, long table keyed by ``bag``."""
    d = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))))
    return undersample(d, label_col, seed, salt, id_col, member_cols=["bag"])


def rus_rounds(df: DataFrame, n_rounds: int, label_col: str = "label",
               seed: int = DEFAULT_SEED, id_col: str = "id") -> DataFrame:
    """The under-samples of all boosting rounds at once, keyed by ``round``."""
    d = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n_rounds - 1))))
    return undersample(d, label_col, seed, "rusboost", id_col, member_cols=["round"])


def balanced_bootstrap(df: DataFrame, n_bags: int = 10, label_col: str = "label",
                       seed: int = DEFAULT_SEED, id_col: str = "id", member_cols: Sequence[str] = ()) -> DataFrame:
    """R2: per bag (of each member), a bootstrap of n rows, then the minority slots of that
    bootstrap plus as many draws *with replacement* from each other class's
    slots. Output keys ``(member_cols, bag, src, slot)``; duplicates stay separate rows."""
    of = list(member_cols)
    salt = [F.col(c) for c in of]
    idx = df.withColumn("_h", hash_hex(seed, "boot-idx", *salt, F.col(id_col)))
    idx = dist_rank(idx, of, "_h", id_col, out="_rk", total="_n").drop("_h")
    idx = idx.withColumn("_idx", F.col("_rk") - 1).drop("_rk")
    # stage 1: slot owned by row j of bag b draws row floor(u * n)
    slots = (idx.select(*of, F.col(id_col).alias("slot"), "_n")
             .withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))))
             .withColumn("_idx", F.floor(uniform(seed, "boot", *salt, F.col("bag"), F.col("slot"))
                                         * F.col("_n")).cast("bigint"))
             .drop("_n"))
    # written once: the counts, the minority's slots and the others' draws all read it
    boot = materialize(slots.join(idx.drop("_n").hint("merge"), on=of + ["_idx"], how="inner").drop("_idx"), "bootstrap")
    # stage 2: per (bag, class) slot counts, minority class per bag
    keys = of + ["bag"]
    counts = boot.groupBy(*keys, label_col).agg(F.count(F.lit(1)).alias("_c"))
    wmin = Window.partitionBy(*keys).orderBy("_c", label_col)
    counts = counts.withColumn("_is_min", F.row_number().over(wmin) == 1)
    minority = counts.filter("_is_min").select(*keys, F.col(label_col).alias("_minlab"))
    others = counts.filter(~F.col("_is_min")).select(
        *keys, F.col(label_col).alias("_olab"), "_c")
    boot = boot.join(F.broadcast(minority), on=keys, how="inner")      # one row per bag
    keep = (boot.filter(F.col(label_col) == F.col("_minlab")).drop("_minlab")
            .withColumn("src", F.lit("keep")))
    maj = boot.filter(F.col(label_col) != F.col("_minlab")).drop("_minlab")
    maj = maj.withColumn("_h", hash_hex(seed, "boot-maj", *salt, F.col("bag"), F.col("slot")))
    maj = dist_rank(maj, keys + [label_col], "_h", "slot", out="_rk").drop("_h")
    maj = maj.withColumn("_idx", F.col("_rk") - 1).drop("_rk")
    # each minority slot drives one draw from every other class of its bag
    draws = (keep.select(*keys, F.col("slot").alias("_drv"))
             .join(F.broadcast(others), on=keys, how="inner")          # one row per (bag, class)
             .withColumn("_idx", F.floor(
                 uniform(seed, "boot-draw", *salt, F.col("bag"), F.col("_olab"), F.col("_drv"))
                 * F.col("_c")).cast("bigint"))
             .select(*keys, F.col("_olab").alias(label_col), "_idx", "_drv"))
    drawn = (draws.join(maj.hint("merge"), on=keys + [label_col, "_idx"], how="inner")
             .drop("_idx", "slot").withColumnRenamed("_drv", "slot")
             .withColumn("src", F.concat(F.lit("draw:"), F.col(label_col).cast("string"))))
    return keep.unionByName(drawn)


def weighted_draw(df: DataFrame, label_col: str = "label", seed: int = DEFAULT_SEED,
                  epoch: int = 0, id_col: str = "id") -> DataFrame:
    """N draws with replacement, weight 1/n_class per row. Equal weight
    inside a class and equal class totals make it 'uniform class, then
    uniform row of it': an equi-join on (class, index)."""
    return weighted_draws(df, [epoch], label_col, seed, id_col).drop("epoch")


def weighted_draws(df: DataFrame, epochs, label_col: str = "label", seed: int = DEFAULT_SEED,
                   id_col: str = "id", member_cols: Sequence[str] = ()) -> DataFrame:
    """R5 for several epochs (and members) at once, keyed by ``epoch``: the rows are ranked
    once (the rank does not depend on the epoch); only the draw owners do."""
    members = list(member_cols)
    salt = [F.col(c) for c in members]
    d = df.withColumn("_h", hash_hex(seed, "wd-idx", *salt, F.col(id_col)))
    d = dist_rank(d, members + [label_col], "_h", id_col, out="_rk", total="_nc").drop("_h")
    d = d.withColumn("_idx", F.col("_rk") - 1).drop("_rk")
    classes = d.select(*members, label_col, "_nc").distinct()
    classes = classes.withColumn(
        "_ord", (F.row_number().over(Window.partitionBy(*members).orderBy(label_col)) - 1).cast("int"))
    # draw owners: one draw per ranked input row (its keys are given) and epoch, read without
    # their ranks; class ordinal from u1, row from u2
    own = df.dropna(subset=members + [label_col]).select(*members, F.col(id_col).alias("draw"))
    # few bytes but many hashes: dealt to a number of tasks that is not reduced for small bytes
    own = own.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *members, "draw").withColumn(
        "epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    if members:      # one row per member
        own = own.join(F.broadcast(classes.groupBy(*members).agg(F.count(F.lit(1)).alias("_k"))), on=members)
        n_classes = F.col("_k")
    else:
        n_classes = classes.select(F.count(F.lit(1))).scalar()  # scalar subquery
    own = own.withColumn("_ord", F.floor(
        uniform(seed, "wd-class", *salt, F.col("epoch"), F.col("draw")) * n_classes).cast("int")).drop("_k")
    own = own.withColumn("_u2", uniform(seed, "wd-row", *salt, F.col("epoch"), F.col("draw")))
    # one row per (member,) class
    own = own.join(F.broadcast(classes), on=members + ["_ord"], how="inner")
    own = own.withColumn("_idx", F.floor(F.col("_u2") * F.col("_nc")).cast("bigint"))
    picked = row_join(own.select(*members, "epoch", "draw", label_col, "_idx"), d.drop("_nc"), members + [label_col, "_idx"])
    return picked.drop("_idx")


def sample_k(df: DataFrame, k_col_or_int, seed: int = DEFAULT_SEED, salt: str = "r6",
             id_col: str = "id") -> DataFrame:
    """``in_sample`` = the row is among the first k by seeded hash; the
    complement is the same pass with the flag false (no positional delete)."""
    d = df.withColumn("_h", hash_hex(seed, salt, F.col(id_col)))
    d = dist_rank(d, [], "_h", id_col, out="_rk", total="_n")
    k = F.lit(k_col_or_int) if isinstance(k_col_or_int, int) else k_col_or_int
    return d.withColumn("in_sample", F.col("_rk") <= k).drop("_h", "_rk", "_n")
