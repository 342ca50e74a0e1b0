"""Voronoi cells of a keyed vector table, for exact neighbour work.

Every key (fold, bag, class) gets pivots: the centres of a few Lloyd steps on a
bounded hash sample of its rows, one pivot for about ``cell_rows`` rows and at
most ``MAX_PIVOTS``. A row belongs to the cell of its nearest pivot. The driver
holds only the pivots and, per cell, the number of rows and the least and
greatest distance to the pivot; all three are bounded by keys x MAX_PIVOTS.

``lower_bounds`` is what makes searches exact: no row of cell j is nearer to a
point q than
    max(|q - p_j| - far_j,  near_j - |q - p_j|,  (|q - p_j|^2 - |q - p|^2) / (2 |p - p_j|))
(triangle inequality twice, and the half-space between p_j and any other pivot
p, here q's nearest).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seeded import uniform
from .blocks import matrix

MAX_PIVOTS = 1024
_PER_PIVOT = 4          # sampled rows for one pivot
_LLOYD = 5
#: Relative slack of all bounds: distances come from inner products.
SLACK = 1e-6


def distances(X: np.ndarray, P: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", X, X)[:, None] + np.einsum("ij,ij->i", P, P)[None, :] - 2.0 * (X @ P.T)
    return np.sqrt(np.maximum(d2, 0.0))


def key_string(keys: Sequence[str]) -> Column:
    """One string for all key columns (no key column: one key for all rows)."""
    if not keys:
        return F.lit("")
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keys])


def _centres(S: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of the sample's rows, the first ones as the start."""
    P = S[:n].copy()
    for _ in range(_LLOYD):
        own = distances(S, P).argmin(axis=1)
        for j in np.unique(own):
            P[j] = S[own == j].mean(axis=0)
    return P


def pivots(rows: DataFrame, keys: Sequence[str], uid: str, feat: str, cell_rows: int) -> dict[str, np.ndarray]:
    """Pivots by key string. A key with at most ``cell_rows`` rows has one cell
    and needs no pivot: it is given a single empty one."""
    ks = rows.select(key_string(keys).alias("k"), F.col(uid).alias("u"), F.col(feat).alias("f"))
    counts = {r["k"]: r["n"] for r in ks.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {k: min(MAX_PIVOTS, -(-n // cell_rows)) for k, n in counts.items()}
    out = {k: np.zeros((1, 0)) for k in counts}
    share = {k: _PER_PIVOT * p / counts[k] for k, p in wanted.items() if p > 1}
    if share:
        rate = ks.sparkSession.createDataFrame(list(share.items()), "k string, rate double")
        drawn = ks.join(F.broadcast(rate), "k").withColumn("h", uniform("pivot", F.col("k"), F.col("u"))).where("h < rate")
        sample: dict[str, list] = {}
        for r in drawn.select("k", "h", "f").collect():      # about 4 rows a pivot
            sample.setdefault(r["k"], []).append((r["h"], r["f"]))
        for k, own in sample.items():
            own.sort()
            S = np.unique(np.array([f for _, f in own], dtype=np.float64), axis=0)
            S = S[np.random.default_rng(0).permutation(len(S))]
            out[k] = _centres(S, min(wanted[k], len(S)))
    return out


def by_key(t: pa.Table, name: str = "_k") -> Iterator[tuple[str, np.ndarray]]:
    """The key strings of a batch with the indices of their rows."""
    enc = pc.dictionary_encode(t.column(name).combine_chunks())
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    codes = enc.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    at = np.searchsorted(codes[order], np.arange(len(enc.dictionary) + 1))
    for i, k in enumerate(enc.dictionary.to_pylist()):
        yield k, order[at[i]:at[i + 1]]


def assign(rows: DataFrame, pv: dict[str, np.ndarray], keys: Sequence[str], feat: str) -> DataFrame:
    """``rows`` with ``_cell`` and ``_dp``, the distance to the cell's pivot."""
    if all(len(p) == 1 for p in pv.values()):
        return rows.withColumn("_cell", F.lit(0)).withColumn("_dp", F.lit(0.0))
    bc = rows.sparkSession.sparkContext.broadcast(pv)
    d = rows.withColumn("_k", key_string(keys))
    schema = T.StructType(list(d.schema.fields) + [T.StructField("_cell", T.IntegerType()), T.StructField("_dp", T.DoubleType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            X = matrix(t, feat)
            cell, dp = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for k, i in by_key(t):
                P = bc.value.get(k)
                if P is not None and len(P) > 1:
                    D = distances(X[i], P)
                    cell[i] = D.argmin(axis=1)
                    dp[i] = D.min(axis=1)
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(cell), pa.array(dp)],
                                             names=list(b.schema.names) + ["_cell", "_dp"])

    return d.mapInArrow(fn, schema).drop("_k")


@dataclass
class Cells:
    """Cells of one key: pivots, rows, least and greatest distance of a row to its pivot."""
    P: np.ndarray
    n: np.ndarray
    near: np.ndarray
    far: np.ndarray


def cell_stats(assigned: DataFrame, pv: dict[str, np.ndarray], keys: Sequence[str]) -> dict[str, Cells]:
    """Per key string; a row per cell reaches the driver."""
    out = {k: Cells(P, np.zeros(len(P), np.int64), np.full(len(P), np.inf), np.zeros(len(P))) for k, P in pv.items()}
    got = assigned.select(key_string(keys).alias("k"), "_cell", "_dp").groupBy("k", "_cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("_dp").alias("lo"), F.max("_dp").alias("hi"))
    for r in got.collect():
        c, j = out[r["k"]], r["_cell"]
        c.n[j], c.near[j], c.far[j] = r["n"], r["lo"], r["hi"]
    return out


def slots(c: Cells, slot_rows: int) -> np.ndarray:
    """A slot number per cell: cells in the order of their pivots along the pivots'
    main direction, filled up to about ``slot_rows`` rows each."""
    if len(c.P) == 1:
        return np.zeros(1, np.int32)
    main = np.linalg.svd(c.P - c.P.mean(axis=0), full_matrices=False)[2][0]
    order = np.argsort(c.P @ main, kind="stable")
    out = np.empty(len(c.P), np.int32)
    at, held = 0, 0
    for j in order:
        if held and held + c.n[j] > slot_rows:
            at, held = at + 1, 0
        out[j] = at
        held += int(c.n[j])
    return out


def lower_bounds(c: Cells, D: np.ndarray) -> np.ndarray:
    """Least possible distance from each point to each cell's rows; ``D``: the
    points' distances to the pivots. Cells without rows are infinitely far."""
    best = D.argmin(axis=1)
    between = distances(c.P, c.P)[best]
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(between > 0, (D ** 2 - D[np.arange(len(D)), best][:, None] ** 2) / (2.0 * between), 0.0)
    low = np.maximum(np.maximum(D - c.far[None, :], half), 0.0)
    low = np.maximum(low, np.where(c.n > 0, c.near, 0.0)[None, :] - D)
    return np.where(c.n[None, :] > 0, low, np.inf)


def upper_bound(c: Cells, D: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each point has at least ``k`` rows (infinite if
    the key has fewer)."""
    reach = np.where(c.n[None, :] > 0, D + c.far[None, :], np.inf)
    order = np.argsort(reach, axis=1)
    have = np.cumsum(c.n[order], axis=1) >= k
    first = have.argmax(axis=1)
    at = np.take_along_axis(reach, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
    return np.where(have.any(axis=1), at, np.inf)
