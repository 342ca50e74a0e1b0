"""F5 fit: train the projection head ``z = tanh(W x + b)`` on fixed base
vectors with the batch-all triplet loss (F3/F4).

Every epoch re-shuffles the rows into batches of 16 (seeded order, salt =
epoch) and groups each batch into one row (at most 16 vectors, whatever the
data size). An epoch is one job: the batches are cut into runs of consecutive
ones, a task walks its run with an optimiser step per batch, and the runs' heads
and optimiser states are averaged JVM-side (``Summarizer.sum``), so one
model-sized vector per epoch reaches the driver. The number of jobs does not
depend on the number of rows, and up to ``RUN_BATCHES`` batches the fit is the
sequential one.

Per batch the loss is the library's batch-all mean: the mean of
``max(0, d(a,p) - d(a,n) + margin)`` over the triplets with a loss above
1e-16 (``y_a = y_p != y_n``, ``a != p``, Euclidean ``d``). The learning rate warms up linearly over
``warmup_steps`` and then decays linearly to zero (the library's schedule).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seeded import seeded_matrix
from ..session import materialize, release
from .blocks import matrix
from .splits import DEFAULT_SEED
from .triplets import BATCH, MARGIN, batches

TENSOR_CHUNK = 256  # batches per NumPy step (bounds task memory)
#: Batches that one task walks in an epoch; beyond them an epoch has several runs.
RUN_BATCHES = 2048


@dataclass
class HeadModel:
    W: np.ndarray
    b: np.ndarray
    history: list[dict] = field(default_factory=list)


def init_head(dim_in: int, dim_out: int, seed: int = DEFAULT_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Seeded uniform(+-sqrt(6/(in+out))) start, the same values the forward
    query and its oracle use."""
    scale = (6.0 / (dim_in + dim_out)) ** 0.5 * 2.0
    W = np.array(seeded_matrix(seed, "head-w", dim_out, dim_in, scale))
    b = np.array([r[0] for r in seeded_matrix(seed, "head-b", dim_out, 1, scale)])
    return W, b


def batch_terms(X: np.ndarray, y: np.ndarray, W: np.ndarray, b: np.ndarray,
                margin: float = MARGIN, grad: bool = True):
    """Loss and gradient of B batches of m rows each.

    ``X``: B x m x d, ``y``: B x m. Returns (per-batch mean losses (B,),
    per-batch active counts (B,), gW summed over batches, gb summed) where the
    gradients are those of the sum of the per-batch mean losses."""
    Z = np.tanh(X @ W.T + b)                                   # B x m x o
    diff = Z[:, :, None, :] - Z[:, None, :, :]                # exact distances
    D2 = np.einsum("bijo,bijo->bij", diff, diff)
    D = np.sqrt(D2)
    m = X.shape[1]
    same = y[:, :, None] == y[:, None, :]
    pos = same & ~np.eye(m, dtype=bool)[None]
    neg = ~same
    L = D[:, :, :, None] - D[:, :, None, :] + margin          # a, p, n
    act = pos[:, :, :, None] & neg[:, :, None, :] & (L > 1e-16)
    n_act = act.sum(axis=(1, 2, 3))
    denom = n_act + 1e-16
    loss = np.where(act, L, 0.0).sum(axis=(1, 2, 3)) / denom
    if not grad:
        return loss, n_act, None, None
    # d loss / d D_ij: +#n per active (i, j=p), -#p per active (i, j=n)
    S = (act.sum(axis=3) - act.sum(axis=2)) / denom[:, None, None]
    Dinv = np.divide(1.0, D, out=np.zeros_like(D), where=D > 0)
    M = S * Dinv
    M = M + M.transpose(0, 2, 1)
    gZ = M.sum(axis=2)[:, :, None] * Z - M @ Z                 # B x m x o
    dU = gZ * (1.0 - Z * Z)
    gW = np.einsum("bmo,bmi->oi", dU, X)
    gb = dU.sum(axis=(0, 1))
    return loss, n_act, gW, gb


def grouped_epoch(df: DataFrame, epoch: int, seed: int = DEFAULT_SEED,
                  batch_size: int = BATCH, id_col: str = "id",
                  feat_col: str = "features", label_col: str = "label") -> DataFrame:
    """One row per batch of the epoch: ``batch, labels, xs`` (<= batch_size
    each, in id order)."""
    b = batches(df.select(id_col, label_col, feat_col), batch_size, seed, epoch, id_col)
    rows = F.sort_array(F.collect_list(F.struct(
        F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"),
        F.col(feat_col).cast("array<double>").alias("x"))))
    g = b.groupBy("batch").agg(rows.alias("_r"))
    return g.select("batch", F.col("_r.y").alias("labels"), F.col("_r.x").alias("xs"))


def _step_sums(grouped: DataFrame, W: np.ndarray, b: np.ndarray, margin: float) -> np.ndarray:
    """[n_batches, loss_sum, active, gW..., gb...] over ``grouped``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    spark = grouped.sparkSession
    bc = spark.sparkContext.broadcast((W, b))

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W_, b_ = bc.value
        o, d = W_.shape
        acc = np.zeros(3 + o * d + o)
        seen = False
        for rb in it:
            if rb.num_rows == 0:
                continue
            t = pa.Table.from_batches([rb])
            ys = t.column("labels").to_pylist()
            xs = t.column("xs").combine_chunks()
            sizes = np.array([len(v) for v in ys])
            flat = matrix(pa.table({"x": xs.flatten()}), "x")
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            for m in np.unique(sizes):
                sel = np.flatnonzero(sizes == m)
                if m < 2:
                    acc[0] += len(sel)   # a batch of one holds no triplet
                    continue
                idx = (starts[sel][:, None] + np.arange(m)[None, :])
                Y = np.array([ys[i] for i in sel], dtype=np.int64)
                for s in range(0, len(sel), TENSOR_CHUNK):
                    Xc = flat[idx[s:s + TENSOR_CHUNK]]
                    loss, n_act, gW, gb = batch_terms(Xc, Y[s:s + TENSOR_CHUNK], W_, b_, margin)
                    acc[0] += len(loss)
                    acc[1] += loss.sum()
                    acc[2] += n_act.sum()
                    acc[3:3 + o * d] += gW.ravel()
                    acc[3 + o * d:] += gb
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))],
                                             names=["v"])

    part = grouped.select("labels", "xs").mapInArrow(fn, "v array<double>")
    tot = part.agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first()
    o, d = W.shape
    return np.asarray(tot["v"]) if tot and tot["v"] is not None else np.zeros(3 + o * d + o)


class Adam:
    """AdamW (betas 0.9 / 0.999) on the head, with a linear warm-up and a linear
    decay to zero over ``total`` steps."""

    def __init__(self, W: np.ndarray, b: np.ndarray, learn_rate: float, warmup: int, total: int, weight_decay: float):
        self.p = [W.astype(np.float64).copy(), b.astype(np.float64).copy()]
        self.m, self.v = ([np.zeros_like(x) for x in self.p] for _ in range(2))
        self.learn_rate, self.warmup, self.total, self.weight_decay, self.t = learn_rate, warmup, total, weight_decay, 0

    def rate(self) -> float:
        if self.t < self.warmup:
            return self.learn_rate * (self.t + 1) / (self.warmup + 1)
        return self.learn_rate * max(0.0, (self.total - self.t) / max(self.total - self.warmup, 1))

    def step(self, gW: np.ndarray, gb: np.ndarray) -> float:
        lr = self.rate()
        self.t += 1
        for P, G, Mo, Ve in zip(self.p, (gW, gb), self.m, self.v):
            Mo *= 0.9
            Mo += 0.1 * G
            Ve *= 0.999
            Ve += 0.001 * G * G
            P -= lr * (Mo / (1 - 0.9 ** self.t) / (np.sqrt(Ve / (1 - 0.999 ** self.t)) + 1e-6) + self.weight_decay * P)
        return lr

    def state(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.p, *self.m, *self.v)])

    def load(self, flat: np.ndarray, t: int) -> None:
        at = 0
        for x in (*self.p, *self.m, *self.v):
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        self.t = t


def _walk(opt: Adam, margin: float, d: int):
    """One run of batches, in order: a step per batch from the epoch's state.
    Gives (batches, loss sum, active triplets, state after the run)."""
    def fn(t):
        own = Adam(*opt.p, opt.learn_rate, opt.warmup, opt.total, opt.weight_decay)
        own.load(opt.state(), opt.t)
        order = np.argsort(t.column("batch").to_numpy(), kind="stable")
        lists = t.column("labels").combine_chunks()
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        y, X = lists.flatten().to_numpy(), matrix(pa.table({"x": t.column("xs").combine_chunks().flatten()}), "x")
        loss = active = 0.0
        for i in order:
            rows = slice(at[i], at[i + 1])
            if at[i + 1] - at[i] < 2:
                continue                      # a batch of one holds no triplet
            ls, n, gW, gb = batch_terms(X[rows][None], y[rows][None].astype(np.int64), *own.p, margin)
            own.step(gW, gb)
            loss, active = loss + float(ls[0]), active + int(n[0])
        n = float(t.num_rows)
        return pa.table({"v": pa.array([np.concatenate([[n, loss, active], n * own.state()]).tolist()], pa.list_(pa.float64()))})
    return fn


def fit(df: DataFrame, epochs: int = 5, steps_per_epoch: int | None = None, learn_rate: float = 0.05,
        warmup_steps: int = 100, weight_decay: float = 0.01, margin: float = MARGIN,
        batch_size: int = BATCH, seed: int = DEFAULT_SEED, dim_out: int | None = None,
        init: tuple[np.ndarray, np.ndarray] | None = None, id_col: str = "id",
        feat_col: str = "features", label_col: str = "label", run_batches: int = RUN_BATCHES) -> HeadModel:
    """F5 fit with AdamW, one step per batch.

    An epoch is one job: its batches are cut into runs of about ``run_batches``
    consecutive ones, a task walks a run step by step from the epoch's head and
    optimiser state, and the runs' heads and states are averaged, weighted by
    their batches. With one run that is the sequential trainer, step for step.
    ``steps_per_epoch`` takes synchronous steps instead, each the mean gradient
    of an equal run of batches (one job per step)."""
    d = len(df.select(feat_col).first()[0])
    W, b = init if init is not None else init_head(d, dim_out or d, seed)
    hist: list[dict] = []
    # every epoch shuffles the same rows: the batch count is fixed
    n_batches = max(1, -(-df.count() // batch_size))
    runs = -(-n_batches // run_batches)
    # steps that one head takes in an epoch
    own_steps = steps_per_epoch or -(-n_batches // runs)
    opt = Adam(W, b, learn_rate, warmup_steps, max(epochs * own_steps, 1), weight_decay)
    o = opt.p[0].shape[0]
    for ep in range(epochs):
        grouped = grouped_epoch(df, ep, seed, batch_size, id_col, feat_col, label_col)
        if steps_per_epoch is None:
            from pyspark.ml.functions import array_to_vector, vector_to_array
            from pyspark.ml.stat import Summarizer
            part = (grouped.withColumn("_run", F.floor(F.col("batch") * runs / F.lit(n_batches)).cast("int"))
                    .groupBy("_run").applyInArrow(_walk(opt, margin, d), "v array<double>"))
            v = np.asarray(part.agg(vector_to_array(Summarizer.sum(array_to_vector("v")))).first()[0])
            lr = opt.rate()
            opt.load(v[3:] / v[0], opt.t + own_steps)
            hist.append({"epoch": ep, "step": 0, "batches": int(v[0]), "n_active": int(v[2]), "loss": float(v[1] / v[0]), "lr": lr,
                         "runs": runs})
            continue
        # consecutive runs of the shuffled batch order, one per step; the step is stored
        # and sorted, so a step's filter reads its own rows
        g = materialize(grouped.withColumn("_step", F.floor(F.col("batch") * steps_per_epoch / F.lit(n_batches)).cast("int"))
                        .sortWithinPartitions("_step"), f"head-epoch{ep}")
        for s in range(steps_per_epoch):
            v = _step_sums(g.filter(F.col("_step") == s), *opt.p, margin)
            nb = max(v[0], 1.0)
            lr = opt.step(v[3:3 + o * d].reshape(o, d) / nb, v[3 + o * d:] / nb)
            hist.append({"epoch": ep, "step": s, "batches": int(v[0]), "n_active": int(v[2]),
                         "loss": float(v[1] / nb), "lr": lr})
        release(g)   # the next epoch re-shuffles: this copy is done
    return HeadModel(W=opt.p[0], b=opt.p[1], history=hist)


def batch_losses(grouped: DataFrame, W: np.ndarray, b: np.ndarray,
                 margin: float = MARGIN) -> DataFrame:
    """Per batch at fixed parameters: ``batch, n_active, loss`` (the batch-all
    mean; NULL when the batch holds no active triplet)."""
    bc = grouped.sparkSession.sparkContext.broadcast((W, b))

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W_, b_ = bc.value
        for rb in it:
            if rb.num_rows == 0:
                continue
            t = pa.Table.from_batches([rb])
            bid = t.column("batch").to_pylist()
            ys = t.column("labels").to_pylist()
            xs = t.column("xs").to_pylist()
            out_b, out_n, out_l = [], [], []
            for i in range(len(bid)):
                loss, n_act, _, _ = batch_terms(np.asarray(xs[i], dtype=np.float64)[None],
                                                np.asarray(ys[i])[None], W_, b_, margin, grad=False)
                out_b.append(bid[i])
                out_n.append(int(n_act[0]))
                out_l.append(float(loss[0]) if n_act[0] > 0 else None)
            yield pa.RecordBatch.from_pydict(
                {"batch": pa.array(out_b, pa.int64()), "n_active": pa.array(out_n, pa.int64()),
                 "loss": pa.array(out_l, pa.float64())})

    return grouped.select("batch", "labels", "xs").mapInArrow(
        fn, "batch long, n_active long, loss double")


def epoch_loss(df: DataFrame, model_or_params, epoch: int = 0, seed: int = DEFAULT_SEED,
               batch_size: int = BATCH, margin: float = MARGIN) -> tuple[float, int, int]:
    """Mean per-batch loss of one epoch's batches at fixed parameters:
    (loss, batches, active triplets)."""
    W, b = ((model_or_params.W, model_or_params.b) if isinstance(model_or_params, HeadModel)
            else model_or_params)
    v = _step_sums(grouped_epoch(df, epoch, seed, batch_size), W, b, margin)
    return float(v[1] / max(v[0], 1.0)), int(v[0]), int(v[2])


def transform(df: DataFrame, model: HeadModel, feat_col: str = "features",
              out: str = "z") -> DataFrame:
    """Apply the head to every row in Arrow batches (W broadcast)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((model.W, model.b))
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W, b = bc.value
        for rb in it:
            if rb.num_rows == 0:
                continue
            X = matrix(pa.Table.from_batches([rb]), feat_col)
            Z = np.tanh(X @ W.T + b)
            arr = pa.FixedSizeListArray.from_arrays(pa.array(Z.ravel()), Z.shape[1]).cast(
                pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [arr],
                                             names=list(rb.schema.names) + [out])

    return df.mapInArrow(fn, schema)
