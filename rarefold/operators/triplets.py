"""Batch-all triplets (F3, F4) and the projection head.

Batches are fixed-size (16) runs of the seeded distributed order. A batch is
gathered into one row and its triplets are reduced to sums by NumPy there, so
neither pairs nor triplets are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_map
from ..functions.seeded import hash_hex
from .blocks import matrix
from .rank import dist_rank
from .splits import DEFAULT_SEED

BATCH = 16
MARGIN = 20.0


def batches(df: DataFrame, batch_size: int = BATCH, seed: int = DEFAULT_SEED,
            epoch: int = 0, id_col: str = "id") -> DataFrame:
    """Shuffled batches: batch = floor((rank - 1) / batch_size) of a seeded order."""
    d = df.withColumn("_h", hash_hex(seed, "batch", epoch, F.col(id_col)))
    d = dist_rank(d, [], "_h", id_col, out="_rk")
    return d.withColumn("batch", F.floor((F.col("_rk") - 1) / batch_size).cast("bigint")).drop("_h", "_rk")


def batch_sums(X: np.ndarray, y: np.ndarray, margin: float) -> tuple[int, int, float]:
    """One batch: valid triplets (y_a = y_p != y_n, a != p), active ones (loss
    above 1e-16) and the sum of ``max(0, d(a,p) - d(a,n) + margin)``."""
    diff = X[:, None, :] - X[None, :, :]
    D = np.sqrt(np.einsum("ijo,ijo->ij", diff, diff))
    same = y[:, None] == y[None, :]
    valid = (same & ~np.eye(len(y), dtype=bool))[:, :, None] & ~same[:, None, :]
    loss = np.where(valid, np.maximum(D[:, :, None] - D[:, None, :] + margin, 0.0), 0.0)
    active = loss > 1e-16
    return int(valid.sum()), int(active.sum()), float(loss[active].sum())


def triplet_losses(batched: DataFrame, margin: float = MARGIN, id_col: str = "id",
                   feat_col: str = "features", label_col: str = "label") -> DataFrame:
    """Per batch with a triplet: ``n_triplets, n_active, loss_sum`` of ``batch_sums``.
    A batch's rows (16 at most) become one row, the only shuffle; no pair or triplet
    leaves its task."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"),
                                                F.col(feat_col).cast("array<double>").alias("x"))))
    grouped = batched.groupBy("batch").agg(rows.alias("_r")).select("batch", F.col("_r.y").alias("y"), F.col("_r.x").alias("x"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = pa.Table.from_batches([b])
            ys = t.column("y").combine_chunks()
            if not len(ys.flatten()):
                continue
            flat, X = ys.flatten().to_numpy(), matrix(pa.table({"x": t.column("x").combine_chunks().flatten()}), "x")
            at = np.concatenate(([0], np.cumsum(pc.list_value_length(ys).to_numpy())))
            sums = [batch_sums(X[at[i]:at[i + 1]], flat[at[i]:at[i + 1]], margin) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*sums))],
                                             names=["batch", "n_triplets", "n_active", "loss_sum"])

    return grouped.mapInArrow(run, "batch long, n_triplets long, n_active long, loss_sum double").where("n_triplets > 0")


def triplet_loss(per_batch: DataFrame) -> DataFrame:
    """mean loss over the active triplets (the library's batch-all mean)."""
    return per_batch.agg(
        (F.sum("loss_sum") / F.sum("n_active")).alias("loss"),
        F.sum("n_active").cast("bigint").alias("n_active"),
        F.sum("n_triplets").cast("bigint").alias("n_triplets"))


def projection_head(x: F.Column, weight: list[list[float]], bias: list[float]) -> F.Column:
    """F5 forward: ``tanh(W x + b)`` in one projection (small W as literals)."""
    z = linear_map(weight, x)
    b = F.array(*[F.lit(float(v)) for v in bias])
    return F.zip_with(z, b, lambda u, c: F.tanh(u + c))
