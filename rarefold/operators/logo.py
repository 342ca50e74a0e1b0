"""Leave-one-group-out classifiers from complements.

A fold tests one group and trains on the union of all others, so whatever a model
learns by adding up rows is, for every fold, the total minus the group's own part:

    train(fold g) = all groups - g

One pass reads the texts and leaves each row with its terms as arrays; the
statistics by group and in total are added up from these, and no fold's training
side is ever read, copied or stored, however many groups there are. A row meets only
the statistics of its own fold: the totals by term (a row per term) and its group's
part by (group, term). Up to ``TASK_WEIGHTS`` of these go to every task, which scores
whole rows; beyond that rows and statistics are joined by (group, term).

The learner is a multinomial naive Bayes on hashed term counts: with T the total
and O the group's own counts of a term in a class,
    log odds(row) = ln (D1 - d1) / (D0 - d0)
                    + sum_t tf_t ln [(T1t - O1t + 1) / (N1 - n1 + V)] / [(T0t - O0t + 1) / (N0 - n0 + V)]
where D, d are rows, N, n tokens (total and own) of a class and V is the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import textfeat

#: Weights (folds x terms) that go to every task, which is 32 MB.
TASK_WEIGHTS = 1 << 22


def class_sums(rows: DataFrame, keys: list[str], value: F.Column, names: tuple[str, str], label_col: str = "label") -> DataFrame:
    """Per key the sums of ``value`` over rows of class 0 and of class 1."""
    own = lambda c: F.coalesce(F.sum(F.when(F.col(label_col) == c, value)), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(own(0).alias(names[0]), own(1).alias(names[1]))


def _score_rows(counts: DataFrame, weighed: DataFrame, n_terms: int) -> DataFrame:
    """``id, fold, label, s, n``: the sum of counts times weights of each row's own
    fold, and of counts."""
    at: dict = {}
    found = [(at.setdefault(r["fold"], len(at)), r["term"], r["w"]) for r in weighed.collect()]     # TASK_WEIGHTS at most
    W = np.zeros((len(at) + 1, n_terms))
    for fold, term, w in found:
        W[fold, term] = w
    bc = counts.sparkSession.sparkContext.broadcast((at, W))
    schema = T.StructType([*[counts.schema[c] for c in ("id", "fold", "label")], T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weights = bc.value
        for b in batches:
            fold = np.array([of.get(f, -1) for f in b.column(1).to_pylist()], np.int64)
            row = np.repeat(np.arange(b.num_rows), textfeat.lengths(b.column(3)))
            term = b.column(3).flatten().to_numpy(zero_copy_only=False)
            tf = b.column(4).flatten().to_numpy(zero_copy_only=False)
            s = np.bincount(row, tf * weights[fold[row], term], minlength=b.num_rows)
            n = np.bincount(row, tf, minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s), pa.array(n)], names=["id", "fold", "label", "s", "n"])

    return counts.select("id", "fold", "label", "terms", "counts").mapInArrow(run, schema)


def naive_bayes(assigned: DataFrame, n_terms: int = 1024, fold_col: str = "fold", id_col: str = "id", text_col: str = "text",
                label_col: str = "label") -> DataFrame:
    """``fold, id, label, proba, pred`` of every row of ``assigned`` (``fold``: the
    one that tests it), by the model of that fold.

    A fold whose training side lacks a class has no odds: ``proba`` and ``pred``
    are null. A row without terms is scored by the classes' shares alone."""
    rows = assigned.select(F.col(fold_col).alias("fold"), F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"),
                           F.when(F.col(id_col).isNotNull(), F.col(text_col)).alias("text"))      # rows without id have no terms
    counts = materialize(textfeat.term_lists(rows, n_terms, keep=("id", "fold", "label")), "logo-counts")
    rows = counts.select("id", "fold", "label")
    again = textfeat.repeated_ids(counts)
    if again is not None:          # each row of an id has the counts of all of them
        same = F.col("id").eqNullSafe(F.col("_again"))
        more = counts.join(again, same, "left_semi")
        more = more.drop("terms", "counts").join(textfeat.add_up(more), "id", "left").select(
            "id", "fold", "label", *[F.coalesce(c, F.array().cast(counts.schema[c].dataType)).alias(c) for c in ("terms", "counts")])
        counts = materialize(counts.join(again, same, "left_anti").unionByName(more), "logo-counts")
    by_term = counts.select("id", "fold", "label", F.explode(F.arrays_zip("terms", "counts")).alias("_x")).select(
        "id", "fold", "label", F.col("_x.terms").alias("term"), F.col("_x.counts").alias("tf"))
    # a row per (fold, term), per fold, per term
    own_terms = materialize(class_sums(by_term, ["fold", "term"], F.col("tf"), ("o0", "o1")), "logo-own")
    total = own_terms.groupBy("term").agg(F.sum("o0").alias("t0"), F.sum("o1").alias("t1"))
    tokens = own_terms.groupBy("fold").agg(F.sum("o0").alias("n0"), F.sum("o1").alias("n1"))
    docs = class_sums(rows, ["fold"], F.lit(1), ("d0", "d1"))
    folds = materialize(docs.join(tokens, "fold", "left").na.fill(0, ["n0", "n1"]), "logo-folds")   # a row per group
    sums = folds.agg(*[F.sum(c).alias("all_" + c) for c in ("d0", "d1", "n0", "n1")])
    v = F.lit(n_terms)
    # what is left for a fold's training side: one row per fold
    left = folds.join(F.broadcast(sums), F.lit(True)).select(
        "fold", *[(F.col("all_" + c) - F.col(c)).alias(c) for c in ("d0", "d1", "n0", "n1")])
    left = left.select("fold", F.when((F.col("d0") > 0) & (F.col("d1") > 0), F.log(F.col("d1") / F.col("d0"))).alias("prior"),
                       F.log((F.col("n0") + v) / (F.col("n1") + v)).alias("size"))
    # the totals have at most n_terms rows
    weighed = (own_terms.join(F.broadcast(total), "term")
               .select("fold", "term", F.log((F.col("t1") - F.col("o1") + 1) / (F.col("t0") - F.col("o0") + 1)).alias("w")))
    if folds.count() * n_terms <= TASK_WEIGHTS:
        out = _score_rows(counts, weighed, n_terms)
        if again is not None:      # and the score of all of them, each by its own fold
            more = out.join(again, same, "left_semi")
            total = more.groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
            out = out.join(again, same, "left_anti").unionByName(more.drop("s", "n").join(total, "id", "left"))
    else:
        scored = by_term.join(weighed, ["fold", "term"]).groupBy("id").agg(
            F.sum(F.col("tf") * F.col("w")).alias("s"), F.sum("tf").alias("n"))
        out = rows.join(scored, "id", "left")
    out = out.join(left, "fold")
    odds = F.col("prior") + F.coalesce(F.col("s") + F.col("n") * F.col("size"), F.lit(0.0))
    # beyond 700 the probability is 1 in doubles anyway; least and greatest would pass over a null
    held = F.when(F.col("prior").isNotNull(), F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0)))
    return out.withColumn("_o", F.round(held, 9)).select(
        "fold", "id", "label", (1 / (1 + F.exp(-F.col("_o")))).alias("proba"), (F.col("_o") > 0).cast("int").alias("pred"))
