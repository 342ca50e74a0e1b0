"""Block grid for all-pairs work (k-NN, LMNN) without emitting row pairs.

Both sides are cut into hash blocks of at most ~``block_rows`` rows per key
(the block count comes from the per-key row count, a table of one row per
key). Every left block meets every right block of its key exactly once in a
cell ``(key, lb, rb)``: left rows are replicated over the right block ids and
right rows over the left block ids, then the two sides are co-grouped on the
cell. A cell is bounded in size whatever the data size, and its function
reduces it (top-k, partial sums) before anything leaves the task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_KEYS = ("_lb", "_rb")


def _with_key(df: DataFrame, key_cols: list[str]) -> tuple[DataFrame, list[str]]:
    if key_cols:
        return df, key_cols
    return df.withColumn("_k0", F.lit(0)), ["_k0"]


def grid(left: DataFrame, right: DataFrame, key_cols: Sequence[str],
         left_uid: str, right_uid: str, block_rows: int = 2048,
         right_key_cols: Sequence[str] | None = None):
    """Replicate both sides onto the cells of their key.

    ``right_key_cols`` lets the right side match on differently named columns
    (renamed to ``key_cols``). Returns ``(left_rep, right_rep, group_cols)``.
    """
    keys = list(key_cols)
    # fresh attribute ids: both sides often derive from the same table
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    if right_key_cols is not None:
        for a, b in zip(right_key_cols, keys):
            if a != b:
                right = right.withColumnRenamed(a, b)
    left, keys2 = _with_key(left, keys)
    right, _ = _with_key(right, keys)
    keys = keys2
    nb = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(block_rows))).cast("int")
    lcount = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ln"))
    rcount = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rn"))
    # one row per key (member, fold or class): hinted, so that rows are not shuffled by
    # it; without key columns it is a single row
    blocks = F.broadcast(lcount.join(rcount, on=keys, how="inner")
              .select(*keys, nb("_ln").alias("_nlb"), nb("_rn").alias("_nrb")))
    lrep = (left.join(blocks, on=keys, how="inner")
            .withColumn("_lb", F.pmod(F.xxhash64(F.col(left_uid)), F.col("_nlb")).cast("int"))
            .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nrb") - 1)))
            .drop("_nlb", "_nrb"))
    rrep = (right.join(blocks, on=keys, how="inner")
            .withColumn("_rb", F.pmod(F.xxhash64(F.col(right_uid)), F.col("_nrb")).cast("int"))
            .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_nlb") - 1)))
            .drop("_nlb", "_nrb"))
    lrep = lrep.select(*[F.col(c).alias(c) for c in lrep.columns])
    rrep = rrep.select(*[F.col(c).alias(c) for c in rrep.columns])
    return lrep, rrep, keys + list(CELL_KEYS)


def matrix(tbl: pa.Table, col: str) -> np.ndarray:
    """Dense float64 matrix from an ``array<double>`` Arrow column."""
    arr = tbl.column(col).combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    vals = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return vals.reshape(n, -1)


def column(tbl: pa.Table, col: str) -> np.ndarray:
    return tbl.column(col).combine_chunks().to_numpy(zero_copy_only=False)


# ---- scans in single precision -----------------------------------------------------

UNIT32 = 2.0 ** -24
LARGE32 = 1e36          # squared norms from here on are left to double precision


def lifted(Z: np.ndarray, z2: np.ndarray, left: bool) -> np.ndarray:
    """Single-precision rows; a left one times a right one is minus their squared distance."""
    one = np.ones((len(Z), 1))
    return np.concatenate([2.0 * Z, -z2[:, None], one] if left else [Z, one, -z2[:, None]], axis=1).astype(np.float32)


def scan_bound(limit: np.ndarray, z2: np.ndarray, most: float, d: int) -> np.ndarray:
    """What the product of ``lifted`` rows exceeds for every pair whose squared distance
    is at most ``limit``, whatever single precision makes of it; ``most``: the other
    side's largest squared norm."""
    room = (d + 16) * UNIT32 * 2.0 * (2.0 * z2 + 2.0 * most + np.where(np.isfinite(limit), np.abs(limit), 0.0))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nextafter((-(limit + room)).astype(np.float32), np.float32(-np.inf))


def hits(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a contiguous mask with few hits, eight places at a time."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    flat = mask.reshape(-1)
    word = np.flatnonzero(flat.view(np.uint64))
    at, bit = np.nonzero(flat.reshape(-1, 8)[word])
    return word[at] * 8 + bit
