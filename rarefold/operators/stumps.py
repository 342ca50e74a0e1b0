"""Weighted decision stumps and boosting (H1-H4), many members at once.

Stump (H1): best single split by weighted Gini over binned features (bins are
``n_bins`` equal-width intervals over each feature's [min, max]; a split sends
bins <= b left), leaves predict their weighted class-1 share.

Boosting (H3, SAMME, two classes): per round the row weight is recomputed
``w = exp(sum_m alpha_m [h_m(x) != y] - c)``, with the driver tracking the
normaliser ``c`` exactly. The sum is carried as a column that is written anew
every ``REFRESH`` rounds, and only the stumps since then are broadcast and scored,
so a round costs the same at any depth and lineage never grows. One ``mapInArrow`` pass per
round bins the features and emits per-partition histograms as vectors; they
are added JVM-side by ``Summarizer.sum`` (partial aggregation), exploded to a
small (member, feature, bin, label) table, and the split is chosen by windows.

Real boosting (SAMME.R, the flavour of RUSBoost and metric boosting): a stump
votes with the log-odds of its leaf instead of a class, and a row's weight is
``w = exp(-0.5 sum_m s log(p_m / (1 - p_m)) - c)`` with s = +-1 for its class. No
round is judged by its error on other rows than it was fitted on, so a stump
fitted on a balanced sample of an unbalanced table never ends the boosting.

Per-round row filters (RUSBoost under-samples, I2/I4) and per-round linear
maps of the features (metric boosting, I4) plug into the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from .blocks import column, matrix
from .voronoi import by_key

N_BINS = 32
REFRESH = 10             # rounds between writings of the carried margins
LEAF_CLIP = 1e-6         # leaf shares are kept off 0 and 1 before the log-odds


@dataclass
class Stump:
    feature: int
    bin: int
    lo: float
    width: float
    p_left: float
    p_right: float
    gain: float = 0.0

    def left(self, X: np.ndarray) -> np.ndarray:
        return bin_index(X[:, self.feature], self.lo, self.width) <= self.bin


@dataclass
class Booster:
    """One member's SAMME ensemble; ``maps[i]`` (or None) maps features for stump i."""
    stumps: list[Stump] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    maps: list[np.ndarray | None] = field(default_factory=list)
    norm: float = 0.0          # c: log of the weight normaliser
    done: bool = False
    errors: list[float] = field(default_factory=list)
    real: bool = False         # SAMME.R: leaves vote with log-odds


def bin_index(v: np.ndarray, lo, width, n_bins: int = N_BINS) -> np.ndarray:
    if np.isscalar(width) and width <= 0:
        return np.zeros(v.shape, dtype=np.int64)
    w = np.where(np.asarray(width) > 0, width, 1.0)
    b = np.floor((v - lo) / w)
    return np.clip(b, 0, n_bins - 1).astype(np.int64)


def _stump_pred(st: Stump, X: np.ndarray) -> np.ndarray:
    p = np.where(st.left(X), st.p_left, st.p_right)
    return (p > 0.5).astype(np.int64)


def leaf_log_odds(p) -> np.ndarray:
    p = np.clip(p, LEAF_CLIP, 1.0 - LEAF_CLIP)
    return np.log(p / (1.0 - p))


def _stump_odds(st: Stump, X: np.ndarray) -> np.ndarray:
    return np.where(st.left(X), leaf_log_odds(st.p_left), leaf_log_odds(st.p_right))


def _mapped(X: np.ndarray, L: np.ndarray | None) -> np.ndarray:
    return X if L is None else X @ L.T


def margins(model: Booster, X: np.ndarray, y: np.ndarray) -> np.ndarray:
    """sum_m alpha_m [h_m(x) != y]; real: -0.5 sum_m s log-odds_m(x)."""
    out = np.zeros(X.shape[0])
    cache: dict[int, np.ndarray] = {}
    for st, a, L in zip(model.stumps, model.alphas, model.maps):
        key = id(L)
        if key not in cache:
            cache[key] = _mapped(X, L)
        if model.real:
            out -= 0.5 * (2.0 * y - 1.0) * _stump_odds(st, cache[key])
        else:
            out += a * (_stump_pred(st, cache[key]) != y)
    return out


def decision(model: Booster, X: np.ndarray) -> np.ndarray:
    """SAMME two-class decision 2 * sum alpha s / sum alpha, s = +-1; real: the
    mean of the leaves' log-odds."""
    if not model.alphas:
        return np.zeros(X.shape[0])
    tot = np.zeros(X.shape[0])
    if model.real:
        for st, L in zip(model.stumps, model.maps):
            tot += _stump_odds(st, _mapped(X, L))
        return tot / len(model.stumps)
    for st, a, L in zip(model.stumps, model.alphas, model.maps):
        tot += a * (2.0 * _stump_pred(st, _mapped(X, L)) - 1.0)
    return 2.0 * tot / float(np.sum(model.alphas))


def _edges_job(df: DataFrame, maps: dict[str, np.ndarray | None], spark) -> dict[str, tuple]:
    """Per member, per (mapped) feature min and max: one pass, model-sized result."""
    bc = spark.sparkContext.broadcast(maps)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        M = bc.value
        lo: dict[str, np.ndarray] = {}
        hi: dict[str, np.ndarray] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X = matrix(t, "features")
            for m, sel in by_key(t, "_m"):
                Z = _mapped(X[sel], M.get(m))
                lo[m] = np.minimum(lo.get(m, np.inf), Z.min(axis=0))
                hi[m] = np.maximum(hi.get(m, -np.inf), Z.max(axis=0))
        for m in lo:
            yield pa.RecordBatch.from_pydict({"_m": [m], "lo": [lo[m].tolist()], "hi": [hi[m].tolist()]})

    part = df.mapInArrow(fn, "_m string, lo array<double>, hi array<double>")
    agg = part.groupBy("_m").agg(
        vector_to_array(Summarizer.min(array_to_vector("lo"))).alias("lo"),
        vector_to_array(Summarizer.max(array_to_vector("hi"))).alias("hi"))
    return {r["_m"]: (np.array(r["lo"]), np.array(r["hi"])) for r in agg.collect()}


def histogram_vectors(df: DataFrame, models: dict[str, Booster], edges: dict[str, tuple],
                      cur_maps: dict[str, np.ndarray | None], n_bins: int = N_BINS) -> DataFrame:
    """``(_m, kind, label, h)`` with ``h`` the flattened (feature, bin) weights.
    Rows may carry a margin ``_mg``, to which those of ``models`` are added."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((models, edges, cur_maps))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mods, edg, cm = bc.value
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X = matrix(t, "features")
            y = t.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            inn = t.column("_in").to_numpy(zero_copy_only=False).astype(bool)
            mg = column(t, "_mg") if "_mg" in t.column_names else np.zeros(t.num_rows)
            for m, sel in by_key(t, "_m"):
                Xm, ym, im = X[sel], y[sel], inn[sel]
                mod = mods[m]
                w = np.exp(mg[sel] + margins(mod, Xm, ym) - mod.norm)
                Z = _mapped(Xm, cm.get(m))
                lo, hi = edg[m]
                width = (hi - lo) / n_bins
                B = bin_index(Z, lo[None, :], width[None, :], n_bins)
                d = Z.shape[1]
                flat = B + (np.arange(d) * n_bins)[None, :]
                for c in (0, 1):
                    h, own = None, ym == c
                    for kind, r in (("all", own), ("fit", own & im)):
                        if not r.any():
                            continue
                        if h is None or r.sum() < own.sum():     # no sample: both kinds are the same rows
                            h = np.bincount(flat[r].ravel(), weights=np.repeat(w[r], d),
                                            minlength=d * n_bins)
                        key = (m, kind, c)
                        acc[key] = acc.get(key, 0) + h
        for (m, kind, c), h in acc.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([m], pa.string()), pa.array([kind], pa.string()),
                 pa.array([c], pa.int32()), pa.array([h.tolist()], pa.list_(pa.float64()))],
                names=["_m", "kind", "label", "h"])

    part = df.mapInArrow(fn, "_m string, kind string, label int, h array<double>")
    # per-partition histograms added JVM-side (partial aggregation of vectors)
    return part.groupBy("_m", "kind", "label").agg(
        vector_to_array(Summarizer.sum(array_to_vector("h"))).alias("h"))


def histogram(df: DataFrame, models: dict[str, Booster], edges: dict[str, tuple],
              cur_maps: dict[str, np.ndarray | None], n_bins: int = N_BINS) -> DataFrame:
    """Weighted histogram ``(_m, kind, label, f, b, w)``; ``kind`` 'fit' counts
    rows with ``_in`` (the round's sample), 'all' counts every row."""
    tot = histogram_vectors(df, models, edges, cur_maps, n_bins)
    long = tot.select("_m", "kind", "label", F.posexplode("h").alias("pos", "w"))
    return long.select("_m", "kind", "label", (F.col("pos") / n_bins).cast("int").alias("f"),
                       (F.col("pos") % n_bins).cast("int").alias("b"), "w")


def best_split_np(h0: np.ndarray, h1: np.ndarray, n_bins: int = N_BINS):
    """``best_splits`` for one member on collected (d x n_bins) class histograms."""
    l0, l1 = np.cumsum(h0, axis=1), np.cumsum(h1, axis=1)
    t0, t1 = l0[:, -1:], l1[:, -1:]
    r0, r1 = t0 - l0, t1 - l1
    W, WL, WR = t0 + t1, l0 + l1, r0 + r1
    with np.errstate(divide="ignore", invalid="ignore"):
        g = lambda a, b: 1.0 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2
        gain = g(t0, t1) - WL / W * g(l0, l1) - WR / W * g(r0, r1)
    ok = (WL > 0) & (WR > 0)
    if not ok.any():
        return None
    gain = np.where(ok, np.round(gain, 9), -np.inf)
    best = gain.max()
    f, b = np.argwhere(gain == best)[0]          # row-major: lowest feature, then bin
    return int(f), int(b), float(l1[f, b] / WL[f, b]), float(r1[f, b] / WR[f, b]), float(best)


def best_splits(hist: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """H1 on a histogram: per member the split with the largest weighted Gini
    decrease (rounded to 1e-9; ties by lowest feature, then bin)."""
    h = hist.filter(F.col("kind") == "fit")
    wide = h.groupBy("_m", "f", "b").agg(
        F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0.0)).alias("w0"),
        F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)).alias("w1"))
    run = Window.partitionBy("_m", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy("_m", "f")
    s = (wide.withColumn("l0", F.sum("w0").over(run)).withColumn("l1", F.sum("w1").over(run))
         .withColumn("t0", F.sum("w0").over(allw)).withColumn("t1", F.sum("w1").over(allw)))
    s = s.withColumn("r0", F.col("t0") - F.col("l0")).withColumn("r1", F.col("t1") - F.col("l1"))
    gini = lambda a, b: 1.0 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2
    W, WL, WR = (F.col("t0") + F.col("t1"), F.col("l0") + F.col("l1"), F.col("r0") + F.col("r1"))
    gain = gini(F.col("t0"), F.col("t1")) - WL / W * gini(F.col("l0"), F.col("l1")) \
        - WR / W * gini(F.col("r0"), F.col("r1"))
    cand = (s.filter((WL > 0) & (WR > 0))
            .withColumn("gain", F.round(gain, 9))
            .withColumn("p_left", F.col("l1") / WL).withColumn("p_right", F.col("r1") / WR))
    pick = Window.partitionBy("_m").orderBy(F.desc("gain"), "f", "b")
    return (cand.withColumn("_r", F.row_number().over(pick)).filter("_r = 1")
            .select("_m", F.col("f").alias("feature"), F.col("b").alias("bin"),
                    "p_left", "p_right", "gain"))


def _with_member(df: DataFrame, member_col: str | None) -> DataFrame:
    return df.withColumn("_m", F.col(member_col).cast("string") if member_col else F.lit("0"))


def _since(model: Booster, at: int) -> Booster:
    """The model with its stumps from ``at`` on: what a round has to score."""
    return Booster(model.stumps[at:], model.alphas[at:], model.maps[at:], model.norm, model.done, real=model.real)


def _carried(base: DataFrame, models: dict[str, Booster]) -> DataFrame:
    """``base`` with the margins of ``models`` added to ``_mg``, written."""
    bc = base.sparkSession.sparkContext.broadcast(models)
    at = base.columns.index("_mg")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            X, y, mg = matrix(t, "features"), column(t, "label").astype(np.int64), column(t, "_mg").copy()
            for m, rows in by_key(t, "_m"):
                mg[rows] += margins(bc.value[m], X[rows], y[rows])
            yield b.set_column(at, "_mg", pa.array(mg))

    return materialize(base.mapInArrow(fn, base.schema), "stumps-margins")


def fit_boost(df: DataFrame, n_rounds: int = 50, member_col: str | None = None,
              n_bins: int = N_BINS,
              sample: Callable[[DataFrame, int], DataFrame] | None = None,
              round_map: Callable[[int, DataFrame, dict[str, Booster]], dict] | None = None,
              real: bool = False, keep: tuple[str, ...] = (), refresh: int = REFRESH) -> dict[str, Booster]:
    """Boosting of stumps (SAMME, or SAMME.R if ``real``) for
    every member at once. ``keep`` names further columns that ``sample`` reads.

    ``sample(rows, r)`` adds a boolean ``_in`` (the rows the round's stump is
    fitted on; all rows when absent); ``round_map(r, sampled, models)`` returns
    per-member feature maps for round ``r`` (metric boosting)."""
    spark = df.sparkSession
    base = _with_member(df.select(*([member_col] if member_col else []), "id", *keep,
                                  F.col("features").cast("array<double>").alias("features"),
                                  F.col("label").cast("int").alias("label")), member_col)
    base = base.drop(member_col) if member_col and member_col != "_m" and member_col not in keep else base
    base = base.withColumn("_mg", F.lit(0.0))
    base = materialize(base, "stumps-1")  # read once per round: cut the lineage once
    members = sorted(r[0] for r in base.select("_m").distinct().collect())
    models = {m: Booster(real=real) for m in members}
    edge_cache: dict[tuple, dict] = {}
    upto = {m: 0 for m in members}           # stumps whose margins the rows carry
    for r in range(n_rounds):
        live = [m for m in members if not models[m].done]
        if not live:
            break
        if r and r % refresh == 0:
            old, base = base, _carried(base, {m: _since(models[m], upto[m]) for m in members})
            release(old)
            upto = {m: len(models[m].stumps) for m in members}
        rows = sample(base, r) if sample else base.withColumn("_in", F.lit(True))
        cur = round_map(r, rows, models) if round_map else {}
        cur = {m: cur.get(m) for m in members}
        ekey = tuple(id(cur[m]) for m in members)
        if ekey not in edge_cache:      # bins change only when the feature map does
            edge_cache = {ekey: _edges_job(base, cur, spark)}
        edges = edge_cache[ekey]
        hv: dict[tuple, np.ndarray] = {}
        recent = {m: _since(models[m], upto[m]) for m in members}
        for h in histogram_vectors(rows, recent, edges, cur, n_bins).collect():
            hv[(h["_m"], h["kind"], h["label"])] = np.asarray(h["h"])  # model-sized
        for m in live:
            lo, hi = edges.get(m, (None, None))
            if lo is None:
                models[m].done = True
                continue
            d = len(lo)
            z = np.zeros(d * n_bins)
            f0 = hv.get((m, "fit", 0), z).reshape(d, n_bins)
            f1 = hv.get((m, "fit", 1), z).reshape(d, n_bins)
            pick = best_split_np(f0, f1, n_bins)
            if pick is None:
                models[m].done = True
                continue
            f, b, pl, pr, gain = pick
            st = Stump(f, b, float(lo[f]), float((hi[f] - lo[f]) / n_bins), pl, pr, gain)
            a0 = hv.get((m, "all", 0), z).reshape(d, n_bins)[f]
            a1 = hv.get((m, "all", 1), z).reshape(d, n_bins)[f]
            left = np.arange(n_bins) <= b
            pred_l, pred_r = int(pl > 0.5), int(pr > 0.5)
            wrong = (a0[left].sum() if pred_l == 1 else a1[left].sum()) + \
                    (a0[~left].sum() if pred_r == 1 else a1[~left].sum())
            tot = a0.sum() + a1.sum()
            err = float(wrong / tot) if tot > 0 else 0.0
            mod = models[m]
            if real:
                mod.stumps.append(st), mod.alphas.append(1.0), mod.maps.append(cur[m])
                mod.errors.append(err)
                if err <= 0.0:
                    mod.done = True
                    continue
                # total of the next round's weights, from this round's leaf totals
                ol, orr = float(leaf_log_odds(pl)), float(leaf_log_odds(pr))
                total = sum(float(w) * np.exp(-0.5 * y * o) for w, y, o in (
                    (a0[left].sum(), -1, ol), (a1[left].sum(), 1, ol),
                    (a0[~left].sum(), -1, orr), (a1[~left].sum(), 1, orr)))
                mod.norm += float(np.log(total))
                continue
            if err >= 0.5:
                if not mod.stumps:           # keep a first stump so the model predicts
                    mod.stumps.append(st), mod.alphas.append(1.0), mod.maps.append(cur[m])
                    mod.errors.append(err)
                mod.done = True
                continue
            if err <= 0.0:
                mod.stumps.append(st), mod.alphas.append(1.0), mod.maps.append(cur[m])
                mod.errors.append(err)
                mod.done = True
                continue
            alpha = float(np.log((1.0 - err) / err))
            mod.errors.append(err)
            mod.stumps.append(st)
            mod.alphas.append(alpha)
            mod.maps.append(cur[m])
            # weights of the next round sum to one: c += log(W * 2 (1 - err))
            mod.norm += float(np.log(tot * 2.0 * (1.0 - err)))
    release(base)   # the models carry everything prediction needs
    return models


def predict_boost(df: DataFrame, models: dict[str, Booster], member_col: str | None = None,
                  feat_col: str = "features") -> DataFrame:
    """H4: ``proba`` = sigmoid(SAMME decision), ``pred`` = decision > 0."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(models)
    d = df.withColumn("_mk", F.col(member_col).cast("string") if member_col else F.lit("0"))
    cols = df.columns
    from pyspark.sql import types as T
    schema = T.StructType(list(d.schema.fields) + [T.StructField("proba", T.DoubleType()),
                                                  T.StructField("pred", T.IntegerType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mods = bc.value
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X = matrix(t, feat_col)
            D = np.zeros(X.shape[0])
            for m, sel in by_key(t, "_mk"):
                D[sel] = decision(mods[m], X[sel])
            proba = 1.0 / (1.0 + np.exp(-D))
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array(proba, pa.float64()),
                                   pa.array((D > 0).astype(np.int32), pa.int32())],
                names=list(b.schema.names) + ["proba", "pred"])

    return d.mapInArrow(fn, schema).select(*cols, "proba", "pred")
