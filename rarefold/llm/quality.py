"""Quality classifier: Bradley-Terry pairwise ranking.

A document's quality is a linear score of step features (a measurement above
each of its quantiles). Weights are learned from preference pairs, a good
document over a bad one, by logistic loss on the difference of their features;
an intercept cancels out. The score is then cut at the quantile that parts the
labelled training rows best, and scaled so that the cut is at ``THRESHOLD``.

Every document's measurements are taken in one pass over its whole text and
quantiles come from all documents. Training takes at most ``SAMPLE`` labelled
rows of each class (those with the smallest hash of their id) and ``PAIRS`` good
documents for each bad one; the fit itself is Spark ML's distributed logistic
regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release, shared_dir
from .common import broadcast_within, fresh, row_key
from .rules import _LETTER, _UPPER, _again, _counts, _per_doc
from .words import chunks

SAMPLE = 20_000
PAIRS = 4
STEPS = 8                          # quantiles of a measurement
THRESHOLD = 0.3
BROADCAST_DOCS = 200_000
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

MEASURES = ["log_words", "mean_word", "symbols", "distinct", "upper", "digits", "punctuation", "duplicate_lines",
            "repeated", "doubled", "non_ascii", "line_words", "longest_word", "short_words", "capital_words",
            "sentence_ends", "bare_words"]


def _by_word(flags: np.ndarray, w) -> np.ndarray:
    return _per_doc(flags, w.at)


def _features(w) -> np.ndarray:
    c = _counts(w).astype(np.float64)
    n, chars, symbols, dup, repeat, lines, letters, upper = c.T
    one, d, size = np.maximum(n, 1), w.data, np.maximum(np.diff(w.doc_start), 1)
    doc = np.repeat(np.arange(w.n_docs), np.diff(w.at))
    _, first = _again(w.hash, doc) if len(w.hash) else (None, np.zeros(0, bool))
    doubled = np.zeros(len(w.hash), dtype=bool)
    doubled[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    longest = np.zeros(w.n_docs)
    np.maximum.at(longest, doc, (w.end - w.start).astype(np.float64))
    letter_sum = np.concatenate(([0], np.cumsum(_LETTER[d] | (d >= 128))))
    last = d[w.end - 1] if len(w.end) else d[:0]
    return np.stack([
        np.log1p(n), chars / one, symbols / one, _by_word(first, w) / one, upper / np.maximum(letters, 1),
        _per_doc(_DIGIT[d], w.doc_start) / size, _per_doc(_PUNCT[d], w.doc_start) / size, dup / np.maximum(lines, 1),
        repeat / one, _by_word(doubled, w) / one, _per_doc(d >= 128, w.doc_start) / size, n / np.maximum(lines, 1),
        np.log1p(longest), _by_word(w.end - w.start <= 3, w) / one, _by_word(_UPPER[d[w.start]], w) / one,
        _by_word((last == ord(".")) | (last == ord("!")) | (last == ord("?")), w) / one,
        _by_word(letter_sum[w.end] == letter_sum[w.start], w) / one], axis=1)


def _measure(batches):
    for b in batches:
        parts = [_features(w) for w in chunks(b.column(1))]
        f = np.round(np.concatenate(parts), 9) if parts else np.zeros((0, len(MEASURES)))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(f[:, i]) for i in range(len(MEASURES))]],
                                         names=["doc_id", *MEASURES])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "long") -> DataFrame:
    """``doc_id`` (as ``kind``) and the measurements of every row's whole text (null: empty)."""
    shared_dir(docs.sparkSession)
    return docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _measure, f"doc_id {kind}, " + ", ".join(f"{m} double" for m in MEASURES))


@dataclass
class Ranker:
    """Bradley-Terry weights over steps, and the cut of the scores."""
    edges: list[list[float]]
    weights: list[list[float]]
    cut: float = 0.0
    scale: float = 1.0

    def raw(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(columns[0]))
        for x, e, w in zip(columns, self.edges, self.weights):
            total += np.concatenate(([0.0], np.cumsum(w)))[np.searchsorted(np.array(e), x, side="left")]
        return np.round(total, 9)


def _steps(edges: list[list[float]]):
    """One-zero steps of the measurements as an array column."""
    return F.array(*[F.when(F.col(m) > F.lit(e), 1.0).otherwise(0.0) for m, es in zip(MEASURES, edges) for e in es])


def _ranked(model: Ranker):
    def run(batches):
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*b.columns[len(MEASURES):], pa.array(model.raw(cols))],
                                             names=[*b.schema.names[len(MEASURES):], "raw"])
    return run


def rank(measured: DataFrame, model: Ranker) -> DataFrame:
    """The rows with ``raw``, the uncut Bradley-Terry score, in place of their measurements."""
    rest = [f"{c} {kind}" for c, kind in measured.dtypes if c not in MEASURES]
    return measured.select(*MEASURES, *[r.split()[0] for r in rest]).mapInArrow(_ranked(model), ", ".join([*rest, "raw double"]))


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS,
        threshold: float = THRESHOLD) -> Ranker:
    """Learn from ``labels`` (``doc_id, good``: 1 or 0; other values and unknown
    ids are ignored; an id with both values is a row of each class). With rows of one class only there is no pair: all weights
    are 0, and every document scores ``threshold``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    probs = [(i + 1) / (STEPS + 1) for i in range(STEPS)] + [0.01, 0.03, 0.97, 0.99]
    found = measured.agg(*[F.percentile_approx(m, probs, 10_000).alias(m) for m in MEASURES]).first()
    edges = [sorted(set(found[m] or [])) for m in MEASURES]
    rows = materialize(measured.join(labels.where("good in (0, 1)").distinct(), "doc_id")
                       .select("doc_id", "good", F.xxhash64("doc_id").alias("r"), *MEASURES), "quality-rows")
    model = Ranker(edges, [[0.0] * len(e) for e in edges])

    def some(good: int):
        s = rows.where(F.col("good") == good).orderBy("r", "doc_id").limit(sample)   # bounded, so one window is too
        return s.select(_steps(edges).alias("x"), (F.row_number().over(Window.orderBy("r", "doc_id")) - 1).alias("i"))

    n = {r.good: min(r.n, sample) for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2 or not any(edges):
        release(rows)
        return model
    bad = some(0).select(F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("k"), "i")
    bad = bad.withColumn("j", ((F.col("i") * pairs + F.col("k")) % F.lit(n[1])).cast("int"))
    pair = bad.join(some(1).withColumnRenamed("i", "j"), "j")
    diff = F.zip_with("x", "y", lambda a, b: a - b)
    turned = F.when(F.col("k") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))       # both outcomes, so both classes
    train = materialize(pair.select(F.transform(diff, lambda v: v * turned).alias("d"),
                                    ((turned + 1) / 2).alias("label")), "quality-pairs")
    lr = LogisticRegression(featuresCol="f", fitIntercept=False, standardization=False, regParam=1e-3, maxIter=40)
    w = lr.fit(train.select(array_to_vector("d").alias("f"), "label")).coefficients.toArray().tolist()
    at = 0
    for i, e in enumerate(edges):
        model.weights[i] = [round(v, 9) for v in w[at:at + len(e)]]
        at += len(e)
    _cut(model, rank(rows.drop("r"), model))
    release(rows, train)
    return model


def _cut(model: Ranker, scored: DataFrame) -> None:
    """The score quantile that parts the classes best; a good document lost
    counts twice."""
    share = scored.agg(F.avg(1 - F.col("good"))).first()[0]
    probs = sorted({min(1.0, max(0.0, share * k / 20)) for k in range(41)})
    q = scored.agg(F.percentile_approx("raw", probs, 100_000), F.percentile_approx("raw", [0.05, 0.95], 1000)).first()
    cuts = sorted(set(q[0]))
    mids = sorted({*cuts, *((a + b) / 2 for a, b in zip(cuts, cuts[1:]))})
    costs = scored.agg(*[F.sum(F.when((F.col("good") == 1) & (F.col("raw") < c), 2)
                               .when((F.col("good") == 0) & (F.col("raw") >= c), 1).otherwise(0)).alias(f"c{i}")
                         for i, c in enumerate(mids)]).first()
    least = min(costs)
    best = [c for c, cost in zip(mids, costs) if cost == least]
    model.cut = best[len(best) // 2]
    model.scale = max((q[1][1] - q[1][0]) / 8, 1e-6)


def score_column(model: Ranker, threshold: float = THRESHOLD):
    """0 to 1; ``threshold`` at the cut."""
    z = (F.col("raw") - F.lit(model.cut)) / F.lit(model.scale) + F.lit(float(np.log(threshold / (1 - threshold))))
    # a score at the cut itself must not fall below the threshold by rounding
    return F.when(F.col("raw") >= model.cut, F.greatest(F.lit(threshold), 1 / (1 + F.exp(-z)))).otherwise(
        F.least(F.lit(threshold - 1e-9), 1 / (1 + F.exp(-z))))


def held_out(doc_id, mod: int, remainder: int):
    """Whether crc32 of the id as text has this remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> tuple[DataFrame, Ranker]:
    """``doc_id, held_out, score, predicted`` of every row, and the model.
    ``labels`` has ``doc_id`` and ``good``; of these only rows whose id is not
    held out are learned from.

    Null and empty texts are scored by their measurements like any text.
    Repeated rows and null ids keep their rows; an empty table gives no rows;
    other columns are ignored."""
    measured = materialize(measure(docs, id_col, text_col), "quality-measures")
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good").cast("int").alias("good"))
    model = fit(measured, lab.where(~held_out(F.col("doc_id"), 5, 0)), threshold=threshold)
    out = rank(measured, model).withColumn("score", score_column(model, threshold))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted")), model


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as
    they were. Learned as in ``classify``, on the rows of ``docs`` that have a label."""
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).alias("t"))
    measured = materialize(measure(keyed, "k", "t", "string"), "quality-measures")
    lab = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("good").cast("int").alias("good"))
    lab = lab.where(~held_out(F.col("id"), 5, 0)).join(keyed.select("id", "k"), "id")
    model = fit(measured, lab.select(F.col("k").alias("doc_id"), "good"), threshold=threshold)
    out = rank(measured, model).where(score_column(model, threshold) < threshold)
    rejected = fresh(docs, "_rejected")
    out = materialize(out.select(F.col("doc_id").alias(rejected)).distinct(), "quality-rejected")
    return docs.join(broadcast_within(out, out.count(), BROADCAST_DOCS), row_key(id_col, text_col) == F.col(rejected),
                     "left_anti")
