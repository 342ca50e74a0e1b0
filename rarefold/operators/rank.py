"""Distributed rank by a hex order key.

A plain ``row_number() over (partition by label order by h)`` puts a whole
class into one task, and a class may hold most of the rows. Here the order key
is bucketed by its leading hex digits (order preserving), bucket sizes are
counted (a table of at most ``16**digits`` rows per key), a running offset is
taken over that small table, and the row number is only taken inside
``(key, bucket)``. The result equals the global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import hex_bucket
from ..session import materialize


def dist_rank(df: DataFrame, part_cols: Sequence[str], hex_col: str,
              tie_col: str, out: str = "rk", total: str | None = None,
              digits: int | None = None) -> DataFrame:
    """Add 1-based ``out`` = rank of ``hex_col`` (ties by ``tie_col``) inside
    ``part_cols``; optionally ``total`` = rows in the partition key.

    ``digits`` (default: session setting ``rarefold.rank.digits``, else 3)
    sets 16**digits buckets per key: about n / 4,096 rows per task at 3; a
    global rank over 10^11 rows is better served by 4 or 5 (the offset table
    grows to 16**digits rows per key, still small)."""
    part_cols = list(part_cols)
    if digits is None:
        digits = int(df.sparkSession.conf.get("rarefold.rank.digits", "3"))
    d = df.withColumn("_bk", hex_bucket(F.col(hex_col), digits))
    # local rank inside (key, bucket): one shuffle of the rows
    local = Window.partitionBy(*part_cols, "_bk").orderBy(F.col(hex_col), F.col(tie_col))
    d = d.withColumn("_lrn", F.row_number().over(local))
    # bucket sizes: at most 16**digits rows per key
    counts = d.groupBy(*part_cols, "_bk").agg(F.max("_lrn").cast("bigint").alias("__cnt"))
    before = Window.partitionBy(*part_cols).orderBy("_bk").rowsBetween(
        Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))
    if total:
        offs = offs.withColumn(
            total, F.sum("__cnt").over(Window.partitionBy(*part_cols)))
    offs = offs.drop("__cnt")
    # a row per key and bucket: with many keys (folds x bags, rounds) as many as there are
    # rows, so they are merged with the rows, which are dealt and sorted by them already,
    # and never sent through the driver
    d = d.join(offs.hint("merge"), on=part_cols + ["_bk"], how="inner")
    return (d.withColumn(out, (F.col("_lrn") + F.col("_off")).cast("bigint"))
             .drop("_bk", "_off", "_lrn"))


def sorted_ordinal(df: DataFrame, col: str, out: str) -> tuple[DataFrame, int]:
    """``df`` (distinct values of ``col``) with ``out``, the 0-based place of each
    in sorted order, and their number. The values are sorted by range, written
    with their partition and place in it, and the sizes of the partitions before
    are added: no task holds all of them."""
    placed = materialize(df.orderBy(col).select(
        col, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "ordinals")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))   # a row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = placed.join(F.broadcast(offs.drop("_n")), on="_p").select(
        col, (F.col("_i") - F.col("_first") + F.col("_off")).cast("int").alias(out))
    return ranked, placed.count()
