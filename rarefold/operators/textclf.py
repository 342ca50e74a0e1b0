"""Text classifier variants (L1-L5), re-aimed from fine-tuned transformers.

The learner is a softmax regression on TF-IDF vectors; what the four
variants differ in is kept: plain (L1), balanced sampling per epoch (L2, the
R5 draw), class-weighted cross-entropy (L3, E3 weights), both (L4). The best
epoch is chosen by lowest evaluation loss (L5); by default evaluation rows are
held out of the training fold (D9).

Training takes steps over batches of 16, as the single-machine trainer does, so
an epoch of n rows is n / 16 steps at any table size. Rows are dealt by id into
shards of about ``SHARD_ROWS`` rows, each packed once as one row of sparse NumPy
buffers. An epoch is one shuffle-free pass: from the epoch's model each shard
takes its own steps in a seeded order, and the shards' models are averaged,
weighted by the class weights of the rows they saw (local SGD). With one shard
that is plain SGD; with ``batch_size=None`` a shard takes one step over all its
rows, and the average is exactly one full-batch step.

Folds are members of one pass. A row is stored once, with its raw counts and its
role in every fold; a fold's IDF (folds x terms numbers, model-sized) turns the
counts into that fold's vectors inside the task, so no fold copies a row. Shards
are stored in the smallest integer types and one is unpacked at a time; batches
are taken from dense runs of at most ``DENSE`` numbers. The driver holds the
weight matrices and IDF rows only.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import resample, splits, textfeat, weights
from ..session import materialize, release, row_join, small_batches
from .blocks import column, matrix

VARIANTS = {"plain": (False, False), "bs": (True, False), "wce": (False, True),
            "bs_wce": (True, True)}
BATCH = 16
SHARD_ROWS = 4096
DENSE = 1 << 19                    # numbers of a dense run of rows (4 MB)
BLOCK = 1 << 25                    # bytes of a shard's rows as one matrix of small integers; larger shards stay sparse
FIT, EVAL, TEST = 0, 1, 2


@dataclass
class TextModel:
    W: np.ndarray                  # classes x (terms + 1), last column is the bias
    best_epoch: int
    history: list[dict] = field(default_factory=list)


def _softmax(Z: np.ndarray) -> np.ndarray:
    Z = Z - Z.max(axis=1, keepdims=True)
    E = np.exp(Z)
    return E / E.sum(axis=1, keepdims=True)


# ---- shards -------------------------------------------------------------------

_SHARD = ("n int, ids binary, label binary, size binary, terms binary, weights binary, roles binary, "
          "drawn binary, epoch binary, copies binary")


def _dump(v: np.ndarray) -> bytes:
    """An array with its type; whole numbers in the smallest type that holds them."""
    if v.dtype.kind == "f" and len(v) and np.isfinite(v).all() and np.abs(v).max() < 1 << 53 and (v == np.trunc(v)).all():
        v = v.astype(np.int64)
    if v.dtype.kind == "i" and len(v):
        v = v.astype(np.result_type(np.min_scalar_type(v.min()), np.min_scalar_type(v.max())))
    out = io.BytesIO()
    np.lib.format.write_array(out, v, allow_pickle=False)
    return out.getvalue()


def _load(b: bytes, kind: type | None = None) -> np.ndarray:
    v = np.lib.format.read_array(io.BytesIO(b), allow_pickle=False)
    return v if kind is None else v.astype(kind, copy=False)


def _pack(t):
    """One shard's rows, in id order, as one row of buffers."""
    t = t.sort_by("id")
    nested = lambda c, kind: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    lens = lambda c: pc.list_value_length(t.column(c)).to_numpy().astype(np.int64)
    cols = {"ids": column(t, "id").astype(np.int64), "label": column(t, "label").astype(np.int64), "size": lens("terms"),
            "terms": nested("terms", np.int64), "weights": nested("weights", np.float64), "roles": nested("roles", np.int64),
            "drawn": np.repeat(np.arange(t.num_rows), lens("draws")), "epoch": nested("draws", np.int64),
            "copies": nested("copies", np.int64)}
    return pa.table({"n": pa.array([t.num_rows], pa.int32()), **{c: pa.array([_dump(v)], pa.binary()) for c, v in cols.items()}})


def shards(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Written shards of ``id, label, terms array<int>, weights array<double>,
    roles array<int>`` (one per member; null: none) and, for balanced sampling,
    ``draws array<int>`` (member * epochs + epoch) with ``copies array<int>``."""
    return _shards(materialize(rows, "text-rows"), shard_rows)


def _shards(own: DataFrame, shard_rows: int) -> DataFrame:
    """``shards`` of written rows, which are released. A shard is a partition, so that
    files hold like many of them and epochs wait for no task."""
    small_batches(own.sparkSession)
    n = max(1, -(-own.count() // shard_rows))
    dealt = own.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartitionById(n, "_shard")
    out = materialize(dealt.groupBy("_shard").applyInArrow(lambda t: _pack(t.drop_columns(["_shard"])), _SHARD), "text-shards")
    release(own)
    return out


class _Shard:
    def __init__(self, r: dict, members: int):
        buf = lambda c, kind=np.int64: _load(r[c], kind)
        self.n = r["n"]
        self.ids, self.label, self.size, self.terms, self.stored = buf("ids"), buf("label"), buf("size"), buf("terms"), buf("weights", None)
        self.roles = buf("roles", np.int8).reshape(self.n, members)
        self.drawn, self.epoch, self.copies = buf("drawn"), buf("epoch"), buf("copies")
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.block: np.ndarray | None = None

    @property
    def weights(self) -> np.ndarray:
        return self.stored.astype(np.float64, copy=False)

    def dense(self, rows: np.ndarray, idf: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Some rows as they are stored, as a matrix, and the member's lengths of them (1 of an
        empty row, and without IDF). A vector is a row x IDF / length; models are scaled by
        the IDF instead (``_scale``). The last column, for the bias, holds the length."""
        X, norm = np.zeros((len(rows), width)), np.ones(len(rows))
        if self.block is None and self.n * (width - 1) * self.stored.itemsize <= BLOCK:
            self.block = np.zeros((self.n, width - 1), self.stored.dtype)
            self.block[np.repeat(np.arange(self.n), self.size), self.terms] = self.stored
        if self.block is not None:
            X[:, :-1] = self.block[rows]
        else:
            size = self.size[rows]
            at = np.repeat(self.at[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            X[np.repeat(np.arange(len(rows)), size), self.terms[at]] = self.stored[at]
        if idf is not None:
            norm = np.sqrt((X * X) @ np.append(idf * idf, 0.0))
            norm = np.where(norm > 0, norm, 1.0)
        X[:, -1] = norm
        return X, norm[:, None]

    def rows(self, member: int, epoch: int, epochs: int, balanced: bool, seed: int) -> np.ndarray:
        """Rows of the member's fit side in the epoch's seeded order."""
        if balanced:
            own = self.epoch == member * epochs + epoch
            rows = np.repeat(self.drawn[own], self.copies[own])
            copy = np.arange(len(rows)) - np.repeat(np.cumsum(self.copies[own]) - self.copies[own], self.copies[own])
        else:
            rows = np.flatnonzero(self.roles[:, member] == FIT)
            copy = np.zeros(len(rows), np.int64)
        keys = [hashlib.md5(f"{seed}:sgd:{member}:{epoch}:{i}:{c}".encode()).digest()
                for i, c in zip(self.ids[rows].tolist(), copy.tolist())]
        return rows[sorted(range(len(rows)), key=keys.__getitem__)]

    def scores(self, rows: np.ndarray, idf: np.ndarray | None, W: np.ndarray) -> np.ndarray:
        """Class scores of some rows."""
        V, run, out = (W * _scale(idf, W.shape[1])).T, max(1, DENSE // W.shape[1]), np.zeros((len(rows), len(W)))
        for a in range(0, len(rows), run):
            X, norm = self.dense(rows[a:a + run], idf, W.shape[1])
            out[a:a + run] = X @ V / norm
        return out

    def steps(self, rows: np.ndarray, idf: np.ndarray | None, W: np.ndarray, cw: np.ndarray, lr: float,
              batch_size: int | None) -> tuple[np.ndarray, int]:
        """``W`` after one step for each batch of ``rows``, and the number of steps."""
        W = W.copy()
        n_steps = 0
        size, width = batch_size or len(rows), W.shape[1]
        scale = _scale(idf, width)
        most = max(1, DENSE // width)                 # rows of a dense run: whole batches, or parts of a batch
        run = most // size * size or size
        for a in range(0, len(rows), run):
            X, norm = self.dense(rows[a:a + run], idf, width) if size <= most else (None, None)
            for s in range(a, min(a + run, len(rows)), size):
                own = rows[s:s + size]
                y, V = self.label[own], (W * scale).T
                w = cw[y] / cw[y].sum()
                grad, bias = np.zeros_like(W), []
                for k in range(0, len(own), most):
                    x, by = self.dense(own[k:k + most], idf, width) if X is None else (X[s - a:s - a + size], norm[s - a:s - a + size])
                    G = _softmax(x @ V / by)
                    G[np.arange(len(x)), y[k:k + most]] -= 1.0
                    G *= w[k:k + most, None]
                    grad += (G / by).T @ x
                    bias.append(G)
                grad *= scale
                grad[:, -1] = [g.sum() for g in (bias[0] if len(bias) == 1 else np.concatenate(bias)).T]
                W -= lr * grad
                n_steps += 1
        return W, n_steps


def _scale(idf: np.ndarray | None, width: int) -> np.ndarray:
    """What a model's columns are multiplied by to take rows as they are stored: the IDF, and 1 for the bias."""
    return np.ones(width) if idf is None else np.append(idf, 1.0)


def _each(batches: Iterator[pa.RecordBatch], members: int) -> Iterator[_Shard]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Shard(b.slice(i, 1).to_pylist()[0], members)


# ---- training -----------------------------------------------------------------

def train(table: DataFrame, members: int, n_terms: int, variant: str = "plain", epochs: int = 10, lr: float = 0.5,
          batch_size: int | None = BATCH, idf: np.ndarray | None = None, class_weights: np.ndarray | None = None,
          n_classes: int = 2, seed: int = splits.DEFAULT_SEED) -> list[TextModel]:
    """One model per member from written ``shards``. The step size falls linearly
    over the epochs. ``idf``: members x terms; ``class_weights``: members x classes."""
    balanced, weighted = VARIANTS[variant]
    cw = class_weights if weighted and class_weights is not None else np.ones((members, n_classes))
    W = np.zeros((members, n_classes, n_terms + 1))
    best = [(np.inf, W[m].copy(), -1) for m in range(members)]
    hist: list[list[dict]] = [[] for _ in range(members)]
    for epoch in range(epochs + 1):                   # the last pass only scores the eval rows
        bc = table.sparkSession.sparkContext.broadcast((W, idf, cw))
        step = lr * (1.0 - epoch / epochs)
        last = epoch == epochs

        def fn(batches: Iterator[pa.RecordBatch], epoch=epoch, step=step, last=last, bc=bc) -> Iterator[pa.RecordBatch]:
            Ws, idfs, cws = bc.value
            acc = np.zeros((members, 4 + Ws[0].size))       # eval loss, eval weight, fit weight, steps, weighted W
            for s in _each(batches, members):
                for m in range(members):
                    own_idf = None if idfs is None else idfs[m]
                    ev = np.flatnonzero(s.roles[:, m] == EVAL)
                    if len(ev):
                        y = s.label[ev]
                        p = _softmax(s.scores(ev, own_idf, Ws[m]))[np.arange(len(ev)), y]
                        acc[m, 0] += (cws[m][y] * -np.log(np.clip(p, 1e-300, None))).sum()
                        acc[m, 1] += cws[m][y].sum()
                    if last:
                        continue
                    rows = s.rows(m, epoch, epochs, balanced, seed)
                    if len(rows):
                        own, n = s.steps(rows, own_idf, Ws[m], cws[m], step, batch_size)
                        w = cws[m][s.label[rows]].sum()
                        acc[m, 2] += w
                        acc[m, 3] += n
                        acc[m, 4:] += w * own.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(members, dtype=np.int32)), pa.array(acc.tolist(), pa.list_(pa.float64()))], names=["m", "v"])

        part = table.mapInArrow(fn, "m int, v array<double>")
        total = part.groupBy("m").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        got = {r["m"]: np.asarray(r["v"]) for r in total.collect()}
        for m in range(members):
            v = got.get(m, np.zeros(4 + W[0].size))
            if epoch:                                  # the loss of the weights after epoch - 1
                loss = v[0] / v[1] if v[1] > 0 else float("nan")
                hist[m][-1]["eval_loss"] = float(loss)
                if loss < best[m][0]:
                    best[m] = (loss, W[m].copy(), epoch - 1)
            if not last:
                hist[m].append({"epoch": epoch, "steps": int(v[3])})
                if v[2] > 0:
                    W[m] = (v[4:] / v[2]).reshape(W[m].shape)
    return [TextModel(b[1] if b[2] >= 0 else W[m], b[2], hist[m]) for m, b in enumerate(best)]


def predict_shards(table: DataFrame, models: list[TextModel], idf: np.ndarray | None = None) -> DataFrame:
    """``member, id, label, proba, pred`` of every member's test rows."""
    members = len(models)
    bc = table.sparkSession.sparkContext.broadcast(([m.W for m in models], idf))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Ws, idfs = bc.value
        for s in _each(batches, members):
            for m in range(members):
                rows = np.flatnonzero(s.roles[:, m] == TEST)
                if len(rows):
                    P = _softmax(s.scores(rows, None if idfs is None else idfs[m], Ws[m]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), m, np.int32)), pa.array(s.ids[rows]), pa.array(s.label[rows].astype(np.int32)),
                         pa.array(P[:, 1]), pa.array(P.argmax(axis=1).astype(np.int32))],
                        names=["member", "id", "label", "proba", "pred"])

    return table.mapInArrow(fn, "member int, id long, label int, proba double, pred int")


# ---- folds of texts -----------------------------------------------------------

@dataclass
class TextFolds:
    """Shards of the texts of some folds; member i is fold ``repeats[i]``."""
    table: DataFrame
    repeats: list[int]
    n_terms: int
    idf: np.ndarray                # folds x terms, 0 for terms that the fold's train side lacks
    class_weights: np.ndarray      # folds x classes, over the fit rows

    def fit(self, variant: str, epochs: int = 10, **kw) -> list[TextModel]:
        return train(self.table, len(self.repeats), self.n_terms, variant, epochs, idf=self.idf,
                     class_weights=self.class_weights, **kw)

    def predict(self, models: list[TextModel]) -> DataFrame:
        at = F.array(*[F.lit(r) for r in self.repeats])
        out = predict_shards(self.table, models, self.idf)
        return out.select(F.element_at(at, F.col("member") + 1).alias("repeat"), "id", "label", "proba", "pred")


def text_folds(texts: DataFrame, folds: DataFrame, n_terms: int = 1024, epochs: int = 10, balanced: bool = False,
               select_on: str = "holdout", shard_rows: int = SHARD_ROWS, seed: int = splits.DEFAULT_SEED) -> TextFolds:
    """``texts`` (id, text) and ``folds`` (repeat, id, label, split) as shards.
    Terms are counted once per text and the IDF of a fold is that of its train
    side; a tenth of the train side is held out for the choice of the epoch,
    unless ``select_on='test'`` (the reference's choice)."""
    side = folds.select("repeat", "id", "label", F.when(F.col("split") == "test", TEST).otherwise(FIT).alias("role"))
    if select_on == "test":
        roles = side      # the test rows choose the epoch too: they are stored once more, as eval rows
    else:
        ev = splits.inner_holdout(folds.where("split = 'train'").select("repeat", "id", "label"), seed=seed)
        roles = ev.select("repeat", "id", "label", F.when(F.col("held_out"), EVAL).otherwise(FIT).alias("role")).unionByName(
            side.where(F.col("role") == TEST))
    roles = materialize(roles, "text-roles")
    repeats = [r[0] for r in roles.select("repeat").distinct().orderBy("repeat").collect()]
    counts, n_train = np.ones((len(repeats), 2)), [0] * len(repeats)
    for r in roles.where(F.col("role") != TEST).groupBy("repeat", "role", "label").count().collect():
        n_train[repeats.index(r["repeat"])] += r["count"]
        if r["role"] == FIT:
            counts[repeats.index(r["repeat"]), r["label"]] = r["count"]
    of = {r: i for i, r in enumerate(repeats)}
    member = F.create_map(*[F.lit(x) for r, i in of.items() for x in (r, i)])[F.col("repeat")]

    def by_member(rows: DataFrame) -> DataFrame:
        """Each row's roles as an array by member."""
        have = rows.groupBy("id", "label").agg(F.map_from_entries(F.collect_list(F.struct(member.alias("m"), "role"))).alias("_r"))
        return have.select("id", "label", F.array(*[F.coalesce(F.col("_r")[i], F.lit(-1)) for i in range(len(repeats))]).alias("roles"))

    rows = by_member(roles)
    if select_on == "test":
        rows = rows.unionByName(by_member(side.where(F.col("role") == TEST).withColumn("role", F.lit(EVAL))))
    counted = textfeat.term_counts(texts, n_terms)
    rows = row_join(rows, counted.select("id", "terms", F.col("counts").cast("array<double>").alias("weights")), "id", "left")
    if balanced:
        drawn = resample.weighted_draws(roles.where(F.col("role") == FIT).select("repeat", "id", "label"), range(epochs),
                                        seed=seed, member_cols=["repeat"])
        per = drawn.groupBy("id", (member * epochs + F.col("epoch")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
        per = per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("_d")).select(
            "id", F.col("_d.at").cast("array<int>").alias("draws"), F.col("_d.n").cast("array<int>").alias("copies"))
        rows = rows.join(per, "id", "left")
    rows = materialize(_with_empty(rows), "text-rows")
    # a row knows the folds that train on it: no row per fold, and none per (document, term)
    trains = [FIT] if select_on == "test" else [FIT, EVAL]
    own = F.filter(F.sequence(F.lit(0), F.lit(len(repeats) - 1)), lambda m: F.get("roles", m).isin(trains))
    n = rows.sparkSession.createDataFrame(pa.table({"member": pa.array(range(len(repeats)), pa.int32()), "_n": pa.array(n_train, pa.int64())}))
    idf = np.zeros((len(repeats), n_terms))
    for r in textfeat.idf_of(textfeat.fold_frequencies(rows.select(own.alias("_folds"), "terms"), n_terms, "member"), n, "member").collect():
        idf[r["member"], r["term"]] = r["idf"]                 # folds x terms at most
    table = _shards(rows, shard_rows)
    release(counted, roles)
    return TextFolds(table, repeats, n_terms, idf, (1 / counts) / (1 / counts).sum(axis=1, keepdims=True))


def _with_empty(rows: DataFrame) -> DataFrame:
    """The columns of ``shards``; what a row lacks is an empty array."""
    own = lambda c, kind: (F.coalesce(F.col(c), F.array().cast(kind)) if c in rows.columns else F.array().cast(kind)).alias(c)
    return rows.select("id", F.col("label").cast("int").alias("label"), own("terms", "array<int>"), own("weights", "array<double>"),
                       "roles", own("draws", "array<int>"), own("copies", "array<int>"))


# ---- one fold of dense vectors ------------------------------------------------

def fit(train_rows: DataFrame, eval_rows: DataFrame, variant: str = "plain", epochs: int = 10,
        lr: float = 2.0, n_classes: int = 2, seed: int = splits.DEFAULT_SEED, batch_size: int | None = None,
        shard_rows: int = SHARD_ROWS) -> TextModel:
    """L1-L5 on ``(id, features array<double>, label)`` rows of one fold;
    ``batch_size=None``: an epoch is one step over all rows."""
    balanced, weighted = VARIANTS[variant]
    d = len(train_rows.select("features").first()[0])
    dense = lambda df, role: df.select("id", "label", F.sequence(F.lit(0), F.lit(d - 1)).alias("terms"),
                                       F.col("features").alias("weights"), F.array(F.lit(role)).alias("roles"))
    rows = dense(train_rows, FIT)
    cw = None
    if weighted:
        cw = np.ones((1, n_classes))
        for r in weights.class_weights(train_rows).collect():
            cw[0, r["label"]] = r["weight_norm"]
    if balanced:
        drawn = resample.weighted_draws(train_rows.select("id", "label"), range(epochs), seed=seed)
        per = drawn.groupBy("id", "epoch").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(
            F.sort_array(F.collect_list(F.struct("epoch", "n"))).alias("_d"))
        rows = rows.join(per.select("id", F.col("_d.epoch").alias("draws"), F.col("_d.n").cast("array<int>").alias("copies")), "id", "left")
    table = shards(_with_empty(rows).unionByName(_with_empty(dense(eval_rows, EVAL))), shard_rows)
    model = train(table, 1, d, variant, epochs, lr, batch_size, None, cw, n_classes, seed)[0]
    release(table)
    return model


def predict(df: DataFrame, model: TextModel) -> DataFrame:
    """Class scores -> argmax (first maximum) and P(class 1)."""
    bc = df.sparkSession.sparkContext.broadcast(model.W)
    schema = T.StructType(list(df.schema.fields) + [T.StructField("proba", T.DoubleType()),
                                                   T.StructField("pred", T.IntegerType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W = bc.value
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X = np.hstack([matrix(t, "features"), np.ones((t.num_rows, 1))])
            P = _softmax(X @ W.T)
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array(P[:, 1], pa.float64()),
                                   pa.array(P.argmax(axis=1).astype(np.int32), pa.int32())],
                names=list(b.schema.names) + ["proba", "pred"])

    return df.mapInArrow(fn, schema)


def select_best(history: DataFrame, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """L5 over a per-epoch metrics table: the epoch with the lowest eval loss
    (of each key)."""
    best = F.min(F.struct("eval_loss", "epoch"))       # ties: the earlier epoch
    return history.groupBy(*key_cols).agg(best.alias("b")).select(*key_cols, F.col("b.epoch").alias("best_epoch"), "b.eval_loss")
