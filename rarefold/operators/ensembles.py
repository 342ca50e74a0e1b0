"""Ensembles (I1-I7) built from the member-keyed learners.

Members (bags, rounds, folds) are key columns, so ten models train in the
same Spark jobs; only small models (stumps, maps) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lmnn, neighbors, resample, stumps
from ..session import materialize, release, row_join
from .blocks import matrix
from .learners import KNN, LMNN, BaseLearner, Boosted, MetricLearner, mapped
from .splits import DEFAULT_SEED


def soft_vote(preds: DataFrame, id_col: str | tuple[str, ...] = "qid", proba_col: str = "proba") -> DataFrame:
    """Mean P(1) over members; class 1 when the mean exceeds one half."""
    # the mean is rounded to 1e-12 before the decision: float sums of member
    # shares (0.4 + 0.6 ...) must not tip an exact tie
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    return (preds.groupBy(*ids).agg(F.avg(proba_col).alias("proba"))
            .withColumn("pred", (F.round("proba", 12) > 0.5).cast("int")))


def predict_mean(df: DataFrame, models: dict[str, stumps.Booster],
                 feat_col: str = "features") -> DataFrame:
    """I7 for boosted members: every row scored by all members in one Arrow
    pass (no per-member copies of the rows); ``proba`` is their mean."""
    bc = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType(list(df.schema.fields) + [T.StructField("proba", T.DoubleType()),
                                                   T.StructField("pred", T.IntegerType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mods = bc.value
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X = matrix(t, feat_col)
            P = np.mean([1.0 / (1.0 + np.exp(-stumps.decision(m, X))) for m in mods.values()], axis=0)
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array(P, pa.float64()),
                                   pa.array((P > 0.5).astype(np.int32), pa.int32())],
                names=list(b.schema.names) + ["proba", "pred"])

    return df.mapInArrow(fn, schema)


# ---- I1: balanced bags of AdaBoost (EasyEnsemble) ---------------------------

def easy_ensemble_fit(train: DataFrame, n_bags: int = 10, n_rounds: int = 50,
                      seed: int = DEFAULT_SEED, feat_col: str = "features") -> dict:
    # bags are drawn on (bag, id, label); the vectors are joined once afterwards
    bags = resample.easy_bags(train.select("id", "label"), n_bags, seed=seed)
    bags = row_join(bags, train.select("id", F.col(feat_col).alias("features")), "id")
    return stumps.fit_boost(bags, n_rounds, member_col="bag")


# ---- I2: RUSBoost -----------------------------------------------------------------

def rusboost_fit(train: DataFrame, n_rounds: int = 50, seed: int = DEFAULT_SEED,
                 metric: bool = False, **lmnn_kw) -> dict:
    """Each round's stump is fitted on that round's under-sample (R4); the weight
    update uses every training row (SAMME.R, so all rounds are kept).

    A round's sample does not depend on the boosting weights, so the samples of
    all rounds are drawn at once on (round, id, label), and a row of the table
    carries the rounds it is in: no round shuffles anything. With ``metric``
    (I4), all rounds' maps are learned in one member-keyed LMNN fit."""
    base = materialize(train.select("id", F.col("features").cast("array<double>").alias("features"), "label"),
                       "ensembles-8")
    draws = materialize(resample.rus_rounds(base.select("id", "label"), n_rounds, seed=seed)
                        .select("round", "id", "label"), "ensembles-9")
    round_map = None
    if metric:
        # a fresh map per round, unweighted (H2)
        maps = lmnn.fit(row_join(draws, base.select("id", "features"), "id"), member_col="round", **lmnn_kw).maps

        def round_map(r: int, rows: DataFrame, models: dict) -> dict:
            return {"0": maps.get(str(r))}

    in_rounds = draws.groupBy("id").agg(F.collect_list("round").alias("rounds"))
    rows = row_join(base, in_rounds, "id", "left")

    def sample(d: DataFrame, r: int) -> DataFrame:
        return d.withColumn("_in", F.coalesce(F.array_contains("rounds", r), F.lit(False)))

    models = stumps.fit_boost(rows, n_rounds, sample=sample, round_map=round_map, real=True, keep=("rounds",))
    release(base, draws)
    return models


def rusboost_folds(train: DataFrame, vectors: DataFrame, n_rounds: int = 50, seed: int = DEFAULT_SEED,
                   metric: bool = False, **lmnn_kw) -> dict:
    """I2 (``metric``: I4) for the training sides (repeat, id, label) of many
    folds: folds are members of the same jobs, all rounds are drawn at once."""
    draws = train.select("repeat", "id", "label").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n_rounds - 1))))
    draws = materialize(resample.undersample(draws, seed=seed, salt="rusboost", member_cols=["repeat", "round"]), "fold-draws")
    round_map = None
    if metric:
        rows = row_join(draws.withColumn("member", F.concat_ws(":", "repeat", "round")), vectors, "id")
        maps = lmnn.fit(rows.select("member", "id", "features", "label"), member_col="member", **lmnn_kw).maps

        def round_map(r: int, rows: DataFrame, models: dict) -> dict:
            return {m: maps.get(f"{m}:{r}") for m in models}

    in_rounds = draws.groupBy("repeat", "id").agg(F.collect_list("round").alias("rounds"))
    rows = row_join(row_join(train.select("repeat", "id", "label"), in_rounds, ["repeat", "id"], "left"), vectors, "id")

    def sample(d: DataFrame, r: int) -> DataFrame:
        return d.withColumn("_in", F.coalesce(F.array_contains("rounds", r), F.lit(False)))

    models = stumps.fit_boost(rows, n_rounds, member_col="repeat", sample=sample, round_map=round_map, real=True, keep=("rounds",))
    release(draws)
    return models


# ---- I3: metric bagging -------------------------------------------------------

@dataclass
class MetricBagging:
    bags: DataFrame                 # (bag, uid, id, features, label), checkpointed
    maps: dict[str, np.ndarray]
    k: int


def bag_slots(train: DataFrame, n_bags: int = 10, seed: int = DEFAULT_SEED, member_cols: tuple[str, ...] = (),
              vectors: DataFrame | None = None) -> DataFrame:
    """R2 slots with a unique long ``uid`` per (member, bag, slot). ``vectors``
    (id, features), if the rows of ``train`` do not have them."""
    # the bootstrap ranks and joins (bag, slot, id, label) only; the vectors
    # are joined once to the finished slots
    of = list(member_cols)
    b = resample.balanced_bootstrap(train.select(*of, "id", "label"), n_bags, seed=seed, member_cols=of)
    # a slot's own row and the draws it drives, one per other class, are told apart by the class's place
    labels = sorted(r[0] for r in train.select("label").distinct().collect())
    src = F.when(F.col("src") == "keep", 0).otherwise(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")))
    uid = F.col("slot") * max(16, len(labels) + 1) + src
    b = b.withColumn("uid", uid.cast("long")).select(*of, "bag", "uid", "id", "label")
    vectors = train.select("id", "features") if vectors is None else vectors
    return row_join(b, vectors, "id").select(*of, "bag", "uid", "id", "features", "label")


def mlbagging_fit(train: DataFrame, n_bags: int = 10, k: int = 5, seed: int = DEFAULT_SEED,
                  metric: bool = True, **lmnn_kw) -> MetricBagging:
    """R2 bags -> LMNN per bag (all bags in the same jobs) -> k-NN per bag."""
    bags = materialize(bag_slots(train, n_bags, seed), "ensembles-1")
    if metric:
        fit = lmnn.fit(bags.select("bag", F.col("uid").alias("id"), "features", "label"),
                       member_col="bag", **lmnn_kw)
        maps = fit.maps
    else:
        maps = {}
    return MetricBagging(bags, maps, k)


def metric_bagging(sides: DataFrame, vectors: DataFrame, n_bags: int = 10, base: BaseLearner = KNN(), metric: MetricLearner = LMNN(),
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """I3 with any base and metric learner, for many folds at once: ``repeat, qid,
    proba, pred`` of the test rows of ``sides`` (repeat, id, label, split). The bags
    of all folds are members of one metric fit and of one base learner's call."""
    train = sides.where("split = 'train'").select("repeat", "id", "label")
    bags = bag_slots(train, n_bags, seed, ("repeat",), vectors)
    bags = materialize(bags.withColumn("member", F.concat_ws(":", "repeat", "bag")), "fold-bags")
    maps = metric.maps(bags, "member")
    test = row_join(sides.where("split = 'test'").select("repeat", "id"), vectors, "id").withColumn(
        "bag", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1)))).withColumn("member", F.concat_ws(":", "repeat", "bag"))
    own = base.probas(mapped(bags.drop("repeat", "bag"), maps, "member"), mapped(test.drop("repeat", "bag"), maps, "member"), "member")
    own = own.withColumn("repeat", F.split("member", ":")[0].cast("int")).withColumnRenamed("id", "qid")
    return soft_vote(own, ("repeat", "qid"))


def mlbagging_folds(sides: DataFrame, vectors: DataFrame, n_bags: int = 10, k: int = 5, seed: int = DEFAULT_SEED,
                    **lmnn_kw) -> DataFrame:
    """I3 as the reference has it: LMNN, then k-NN."""
    return metric_bagging(sides, vectors, n_bags, KNN(k), LMNN(options=lmnn_kw), seed)


def mlbagging_predict(test: DataFrame, model: MetricBagging) -> DataFrame:
    """k-NN of every test row inside every bag (bag slots as separate points),
    in each bag's metric; mean of the bags' P(1)."""
    bag_ids = sorted(r[0] for r in model.bags.select("bag").distinct().collect())
    rep = test.select("id", "features").withColumn(
        "bag", F.explode(F.array(*[F.lit(b) for b in bag_ids])))  # n_bags copies
    train = model.bags
    if model.maps:
        rep = lmnn.apply_map(rep, model.maps, member_col="bag").drop("features") \
            .withColumnRenamed("z", "features")
        train = lmnn.apply_map(train, model.maps, member_col="bag").drop("features") \
            .withColumnRenamed("z", "features")
    nb = neighbors.knn(rep, train, model.k, key_cols=["bag"], train_uid="uid")
    return soft_vote(neighbors.knn_predict(nb, ["bag"]))


# ---- I6a / I6: metric boost-stacking -------------------------------------------

def redivide(state: DataFrame, correct: DataFrame, n_train: int, iteration: int,
             seed: int = DEFAULT_SEED, promote: str = "wrong") -> DataFrame:
    """I6a in one ranked projection: valid rows whose prediction is ``promote``
    ('wrong': misclassified, the stated intent; 'correct': as the reference's
    code reads) rank first, every other row (old train and the rest of valid)
    follows in seeded order; the first ``n_train`` rows are the new train side.
    |train| and |valid| never change; promoted rows beyond |train| stay valid."""
    from ..functions.seeded import hash_hex
    from .rank import dist_rank
    d = state.join(correct.select("id", "correct"), on="id", how="left")
    want = F.lit(promote == "correct")
    moved = (F.col("side") == "valid") & (F.col("correct") == want)
    key = F.concat(F.when(moved, F.lit("0")).otherwise(F.lit("1")),
                   hash_hex(seed, "i6", iteration, F.col("id")))
    d = dist_rank(d.withColumn("_key", key), [], "_key", "id", out="_rk")
    return d.select("id", F.when(F.col("_rk") <= n_train, "train").otherwise("valid").alias("side"))


@dataclass
class BoostStack:
    stacked: np.ndarray            # all learned maps stacked: z = [L1 x, L2 x, ...]
    models: dict
    iterations: list[dict]


def mlboostacking_fit(train: DataFrame, max_iteration: int = 10, k: int = 5,
                      n_bags: int = 10, n_rounds: int = 50, seed: int = DEFAULT_SEED,
                      promote: str = "wrong", base: BaseLearner | None = None, metric: MetricLearner | None = None,
                      sampling="auto", **lmnn_kw) -> BoostStack:
    """Per iteration under-sample the train side, learn a map on it, score
    the valid side with k-NN in the concatenation of all maps so far, move rows
    (I6a); finally an EasyEnsemble on all rows in the concatenated space.
    The concat of maps is one stacked matrix, so nothing is re-transformed.
    ``base`` (default: k-NN), ``metric`` (LMNN) and ``sampling`` are plug-ins."""
    from . import scoring
    from .splits import random_halves
    learner, metric = base or KNN(k), metric or LMNN(options=lmnn_kw)
    one = lambda df: df.withColumn("member", F.lit("0"))
    base = materialize(train.select(
        "id", F.col("features").cast("array<double>").alias("features"), "label"), "ensembles-2")
    state = random_halves(base, seed=seed).select(
        "id", F.when(F.col("split") == "train", "train").otherwise("valid").alias("side"))
    state = materialize(state, "ensembles-3")
    n_train = state.filter(F.col("side") == "train").count()
    maps: list[np.ndarray] = []
    log: list[dict] = []
    for it in range(max_iteration):
        rows = row_join(base, state, "id")
        tr = rows.filter(F.col("side") == "train").drop("side")
        va = rows.filter(F.col("side") == "valid").drop("side")
        us = resample.undersample(tr, seed=seed, salt=f"i6:{it}", strategy=sampling)
        learned = metric.maps(one(us), "member")
        maps.append(learned["0"] if learned else np.eye(len(base.select("features").first()[0])))
        L = np.vstack(maps)
        ztr = lmnn.apply_map(tr, L).drop("features").withColumnRenamed("z", "features")
        zva = lmnn.apply_map(va, L).drop("features").withColumnRenamed("z", "features")
        pred = learner.probas(one(ztr), one(zva), "member").select(
            F.col("id").alias("qid"), "proba", (F.col("proba") > 0.5).cast("int").alias("pred")).join(
            va.select(F.col("id").alias("qid"), "label"), on="qid")
        pred = materialize(pred, "ensembles-4")
        card = scoring.scorecard_wide(pred).first()          # D16: kept, not dropped
        log.append({"iteration": it, **{m: card[m] for m in scoring.SCORE_METRICS + ["auc"]}})
        correct = pred.select(F.col("qid").alias("id"),
                              (F.col("pred") == F.col("label")).alias("correct"))
        new_state = materialize(redivide(state, correct, n_train, it, seed, promote), "ensembles-5")
        release(pred, state)   # both are read only through the new membership table
        state = new_state
    stacked = np.vstack(maps)
    z = lmnn.apply_map(base, stacked).drop("features").withColumnRenamed("z", "features")
    models = easy_ensemble_fit(z, n_bags, n_rounds, seed)
    release(base, state)
    return BoostStack(stacked, models, log)


def mlboostacking_transform(df: DataFrame, model: BoostStack) -> DataFrame:
    """``df`` with its features under all learned maps, one after the other."""
    return lmnn.apply_map(df, model.stacked).drop("features").withColumnRenamed("z", "features")


def mlboostacking_predict(test: DataFrame, model: BoostStack) -> DataFrame:
    return predict_mean(mlboostacking_transform(test, model), model.models)


# ---- I5: metric stacking ----------------------------------------------------------

@dataclass
class Stacking:
    models: dict                     # member "e:f" (fold f, or "all") -> Booster with maps
    final: dict                      # EasyEnsemble on [member probabilities, features]
    n_estimators: int


def _member_probas(df: DataFrame, models: dict, n_estimators: int, fold_col: str | None,
                   feat_col: str = "features") -> DataFrame:
    """``meta`` = P(1) of estimators 0..n-1; a row uses the models of its own
    out-of-fold slot (``fold_col``) or the refitted ones ('all')."""
    bc = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType(list(df.schema.fields) +
                          [T.StructField("meta", T.ArrayType(T.DoubleType()))])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mods = bc.value
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            X = matrix(t, feat_col)
            folds = (t.column(fold_col).to_pylist() if fold_col else ["all"] * t.num_rows)
            P = np.zeros((t.num_rows, n_estimators))
            folds = np.array([str(f) for f in folds], dtype=object)
            for f in set(folds.tolist()):
                sel = folds == f
                for e in range(n_estimators):
                    P[sel, e] = 1.0 / (1.0 + np.exp(-stumps.decision(mods[f"{e}:{f}"], X[sel])))
            arr = pa.FixedSizeListArray.from_arrays(pa.array(P.ravel()), n_estimators).cast(
                pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(b.columns) + [arr],
                                             names=list(b.schema.names) + ["meta"])

    return df.mapInArrow(fn, schema)


def mlstacking_fit(train: DataFrame, n_estimators: int = 10, n_folds: int = 5,
                   n_rounds: int = 50, seed: int = DEFAULT_SEED, **lmnn_kw) -> Stacking:
    """Base learners (under-sample -> LMNN -> AdaBoost), out-of-fold P(1)
    per learner on 5 stratified folds plus refits on all rows, all trained as
    members of the same jobs; meta row = [P(1) of each learner, features]
    (passthrough); final learner: EasyEnsemble."""
    from .splits import oof_folds
    base = materialize(oof_folds(train.select(
        "id", F.col("features").cast("array<double>").alias("features"), "label"),
        n_folds=n_folds, seed=seed), "ensembles-6")
    slots = [str(f) for f in range(n_folds)] + ["all"]
    # members are drawn on (member, id, label); the vectors are joined once afterwards
    rows = base.select("id", "label", "oof").withColumn("_slot", F.explode(F.array(*[F.lit(s) for s in slots])))
    rows = rows.filter((F.col("_slot") == "all") | (F.col("_slot") != F.col("oof").cast("string")))
    rows = rows.withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))))
    rows = rows.withColumn("member", F.concat_ws(":", F.col("_e").cast("string"), "_slot"))
    us = materialize(resample.undersample(rows.select("member", "id", "label"), seed=seed, salt="i5",
                                          member_cols=["member"]).join(base.select("id", "features").hint("merge"), on="id"),
                     "ensembles-7")
    maps = lmnn.fit(us, member_col="member", **lmnn_kw).maps
    models = stumps.fit_boost(us, n_rounds, member_col="member",
                              round_map=lambda r, rows_, mods: maps)
    meta = _member_probas(base, models, n_estimators, "oof")
    meta = meta.select("id", "label", F.concat("meta", "features").alias("features"))
    final = easy_ensemble_fit(meta, seed=seed, n_rounds=n_rounds)
    release(base, us)
    return Stacking(models, final, n_estimators)


def stacking_meta(train: DataFrame, n_estimators: int = 10, n_folds: int = 5, base: BaseLearner = Boosted(), metric: MetricLearner = LMNN(),
                  sampling="auto", seed: int = DEFAULT_SEED) -> DataFrame:
    """I5's meta rows with any learners: ``id, label, features`` = the out-of-fold
    P(1) of every estimator, then the row's own features (passthrough). Estimators
    x folds are the members of one metric fit and one base learner's call."""
    from .splits import oof_folds
    rows = materialize(oof_folds(train.select("id", F.col("features").cast("array<double>").alias("features"), "label"),
                                 n_folds=n_folds, seed=seed), "meta-base")
    each = rows.select("id", "label", "oof").withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))))
    fit = each.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).where("_f <> oof").select(
        F.concat_ws(":", "_e", "_f").alias("member"), "id", "label")
    vectors = rows.select("id", "features")
    us = materialize(resample.undersample(fit, seed=seed, salt="i5", member_cols=["member"], strategy=sampling).join(vectors.hint("merge"), "id"), "meta-draws")
    maps = metric.maps(us, "member")
    test = each.select(F.concat_ws(":", "_e", "oof").alias("member"), "id").join(vectors.hint("merge"), "id")
    own = base.probas(mapped(us, maps, "member"), mapped(test, maps, "member"), "member")
    meta = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        F.split("member", ":")[0].cast("int").alias("e"), "proba"))).alias("_p"))       # n_estimators entries
    return rows.join(meta, "id").select("id", "label", F.concat(F.col("_p.proba"), "features").alias("features"))


def mlstacking_predict(test: DataFrame, model: Stacking) -> DataFrame:
    meta = _member_probas(test, model.models, model.n_estimators, None)
    meta = meta.withColumn("features", F.concat("meta", "features")).drop("meta")
    return predict_mean(meta, model.final)


# ---- I4: metric boosting -----------------------------------------------------------

def mlboosting_fit(train: DataFrame, n_rounds: int = 50, seed: int = DEFAULT_SEED, **lmnn_kw) -> dict:
    """I4: RUSBoost whose weak learner is LMNN -> stump. Each round's map is
    learned afresh and unweighted on that round's under-sample (H2); the stump is
    fitted with the boosting weights."""
    return rusboost_fit(train, n_rounds, seed, metric=True, **lmnn_kw)
