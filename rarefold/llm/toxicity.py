"""Toxicity: maximum-scoring segments of token log-odds.

*Lexicon.* Units are words (runs of letters, A-Z lower-cased) and their first 4,
5 and 6 bytes, each counted once a document. A unit's weight is its log-odds
between toxic and other training documents under an informative Dirichlet prior,
whose pseudo-counts follow the unit's share of the whole corpus. Units that toxic
documents favour significantly (likelihood ratio, corrected for the number of
units tried) make the lexicon, all of them; all other words share one small negative
weight. The lexicon grows with the labelled sample (``SAMPLE``), not with the corpus.

*Scan.* The weights of a text's words are scanned once, in linear time, for all
maximal scoring segments (Ruzzo and Tompa): every toxic passage, not only the best.

*Calibration.* The best segment of n unrelated words exceeds x with probability
1 - exp(-K n exp(-lambda x)). lambda solves sum p exp(lambda s) = 1 over the corpus'
distribution of weights, K is fitted on clean training documents. A document's
evidence is the sum over its segments of lambda s - ln(K n), where positive; the
evidence that parts the training documents best is scaled to ``THRESHOLD``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, shared_dir
from .quality import held_out
from .words import chunks, mix

SAMPLE = 20_000                    # labelled rows of each class that are learned from (smallest hash of the id)
PREFIXES = (4, 5, 6)
PRIOR = 20.0                       # pseudo-documents
LEAST_TOXIC = 3                    # toxic training documents that a unit must be in
MOST_WEIGHT = 6.0
OTHER_WEIGHT = -0.2                # a passage may bridge some 20 words between two toxic ones
THRESHOLD = 0.7
_OTHER = np.ones(256, dtype=bool)  # separates words
_OTHER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SALTS = [np.uint64(0), *[np.uint64(0xA0761D6478BD642F * (2 * k + 1) % (1 << 64)) for k in range(len(PREFIXES))]]


def _units(w) -> np.ndarray:
    """words x (1 + prefixes) unit hashes; 0 where a word is shorter than a prefix."""
    out = [w.hash]
    for k, salt in zip(PREFIXES, _SALTS[1:]):
        long = w.end - w.start >= k
        h = np.zeros(len(w.hash), np.uint64)
        h[long] = mix(w.span_hash(w.start[long], w.start[long] + k) ^ salt)
        out.append(h)
    return np.stack(out, axis=1)


def _docs_of(w) -> np.ndarray:
    return np.repeat(np.arange(w.n_docs), np.diff(w.at))


def _once_a_document(w) -> tuple[np.ndarray, np.ndarray]:
    """(document, unit), each pair once."""
    u = _units(w)
    doc, u = np.repeat(_docs_of(w), u.shape[1]), u.ravel()
    doc, u = doc[u != 0], u[u != 0]
    order = np.lexsort((u, doc))
    doc, u = doc[order], u[order]
    new = np.ones(len(u), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (u[1:] != u[:-1])
    return doc[new], u[new]


def _count_labelled(batches):
    """(unit, toxic, n) of labelled texts, summed per chunk; unit 0 counts documents."""
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False)
        for w in chunks(b.column(0), lower=True, space=_OTHER):
            own = toxic[w.first:w.first + w.n_docs]
            doc, u = _once_a_document(w)
            for label in (0, 1):
                h, n = np.unique(u[own[doc] == label], return_counts=True)
                h, n = np.append(h, np.uint64(0)), np.append(n, int((own == label).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), label, np.int32)),
                                                  pa.array(n.astype(np.int64))], names=["unit", "toxic", "n"])


def _count_corpus(units):
    """Documents and words with the given units, summed per task; unit 0 counts all."""
    def run(batches):
        known = units.value
        docs, words = np.zeros(len(known) + 1, np.int64), np.zeros(len(known) + 1, np.int64)
        for b in batches:
            for w in chunks(b.column(0), lower=True, space=_OTHER):
                docs[-1] += w.n_docs
                words[-1] += len(w.hash)
                for total, h in ((words, _units(w).ravel()), (docs, _once_a_document(w)[1])) if len(known) else ():
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    total += np.bincount(at[known[at] == h], minlength=len(total))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(known, np.uint64(0))[some].view(np.int64)), pa.array(docs[some]), pa.array(words[some])],
            names=["unit", "docs", "words"])
    return run


@dataclass
class Lexicon:
    units: np.ndarray              # sorted hashes
    weights: np.ndarray
    other: float                   # weight of all other words
    rate: float                    # lambda
    k: float = 1.0
    cut: float = 1.0

    def word_weights(self, w) -> np.ndarray:
        """Each word's largest weight over its units."""
        out = np.full(len(w.hash), self.other)
        if len(self.units):
            u = _units(w)
            at = np.minimum(np.searchsorted(self.units, u), len(self.units) - 1)
            known = self.units[at] == u
            best = np.where(known, self.weights[at], -np.inf).max(axis=1)
            out = np.where(best > -np.inf, best, out)
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in linear time."""
    pos = np.flatnonzero(scores > 0)
    if not len(pos):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list[float]] = []          # start, end, sum before, sum at the end
    down: list[int] = []                   # for each: the last one before it with a smaller sum before
    for p in pos.tolist():
        cur = [p, p + 1, total[p], total[p + 1]]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= cur[2]:
                j = down[j]
            if j < 0 or found[j][3] >= cur[3]:
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:], down[j:]
            j -= 1
        found.append(cur)
        down.append(j)
    return [(int(a), int(b), round(float(r - left), 9)) for a, b, left, r in found]


_SEGMENT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(model):
    def run(batches):
        lex = model.value
        for b in batches:
            for w in chunks(b.column(1), lower=True, space=_OTHER):
                s = lex.word_weights(w)
                has = np.bincount(_docs_of(w)[s > 0], minlength=w.n_docs) > 0
                segs = [[{"start": a, "end": z, "score": v} for a, z, v in segments(s[w.at[i]:w.at[i + 1]])] if has[i] else []
                        for i in range(w.n_docs)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, w.n_docs), pa.array(np.diff(w.at)),
                                                  pa.array(segs, _SEGMENT)], names=["doc_id", "n_words", "segments"])
    return run


def scan(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, segments`` (word ranges and scores) of every row."""
    spark = docs.sparkSession
    shared_dir(spark)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scan(spark.sparkContext.broadcast(lexicon)),
        "doc_id long, n_words long, segments array<struct<start: long, end: long, score: double>>")


def _rate(weights: np.ndarray, probs: np.ndarray) -> float:
    """The positive root of sum p exp(rate s) = 1 (0 if the mean is not negative
    or nothing is positive)."""
    if not (weights > 0).any() or float(weights @ probs) >= 0:
        return 0.0
    low, high = 0.0, 1.0
    value = lambda r: float(probs @ np.exp(np.minimum(r * weights, 700.0))) - 1
    while value(high) < 0:
        low, high = high, 2 * high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows ``doc_id, toxic`` of each class, so that a join may
    broadcast them; other values are left out. For ``learn`` only, which takes each
    class' counts against that class' own size: there the mix does not matter."""
    some = [labels.where(F.col("toxic") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return F.broadcast(materialize(some[0].unionByName(some[1]), "toxic-labels"))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon and weights from ``training_rows`` (``doc_id, toxic``) and the
    whole corpus. Without toxic rows it is empty."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.join(labels, "doc_id").select("text", "toxic")
    counts = materialize(rows.mapInArrow(_count_labelled, "unit long, toxic int, n long").groupBy("unit").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")), "toxic-counts")
    sums = counts.where("unit = 0").first()
    n_t, n_c = (float(sums.t), float(sums.c)) if sums else (0.0, 0.0)
    if not n_t or not n_c:
        release(counts)
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), -0.1, 0.0)
    tried = counts.where((F.col("unit") != 0) & (F.col("t") >= LEAST_TOXIC))
    n_tried = tried.count()
    both = F.col("t") + F.col("c")
    term = lambda x, n: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (both * n / (n_t + n_c)))).otherwise(0.0)
    more = tried.where((F.col("t") / n_t > 2 * F.col("c") / n_c)
                       & (2 * (term("t", n_t) + term("c", n_c)) >= 2 * float(np.log(max(2.0, float(n_tried))))))
    some = more.select("unit", "t", "c").collect()
    units = np.array([r.unit for r in some], np.int64).view(np.uint64)
    order = np.argsort(units)
    units = units[order]
    t, c = (np.array([r[x] for r in some], float)[order] for x in ("t", "c"))
    known = spark.sparkContext.broadcast(units)
    corpus = {r.unit: (r.d, r.w) for r in docs.select("text").mapInArrow(_count_corpus(known), "unit long, docs long, words long")
              .groupBy("unit").agg(F.sum("docs").alias("d"), F.sum("words").alias("w")).collect()}
    known.unpersist()
    release(counts)
    total = corpus.get(0, (1, 1))
    seen = np.array([corpus.get(int(u), (0, 0)) for u in units.view(np.int64)], float).reshape(-1, 2)
    prior = PRIOR * np.maximum(seen[:, 0], 1) / max(1, total[0])
    odds = (np.log((t + prior) / (n_t + PRIOR - t - prior + 1e-9))
            - np.log((c + prior) / (n_c + PRIOR - c - prior + 1e-9)))
    keep = np.flatnonzero(odds > 1)
    units, weights, share = units[keep], np.minimum(odds[keep], MOST_WEIGHT), seen[keep, 1] / max(1, total[1])
    # shares of prefixes hold those of their words, so the rest is counted low rather than high
    rest = 1 - min(0.5, float(share.sum()))
    other = OTHER_WEIGHT
    probs = np.append(share, rest)
    rate = _rate(np.append(weights, other), probs / probs.sum())
    return Lexicon(units, np.round(weights, 9), other, round(rate, 9))


def evidence(lexicon: Lexicon):
    n = F.greatest(F.col("n_words"), F.lit(1)) * F.lit(lexicon.k)
    return F.round(F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.greatest(
        F.lit(0.0), F.lit(lexicon.rate) * s["score"] - F.log(n))), 9)


def calibrate(scanned: DataFrame, labels: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Fit K on clean rows of ``labels`` (``doc_id, toxic``), then the cut of the
    evidence on all: every labelled row counts, so the mix is that of the table. No
    texts are joined."""
    known = labels.where("toxic in (0, 1)").distinct()
    rows = materialize(scanned.select("doc_id", "n_words", "segments").join(known, "doc_id"), "toxic-rows")
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    clean = rows.where("toxic = 0").agg(F.count("*"), F.sum(F.col("n_words") * F.exp(-F.lit(lexicon.rate) * best))).first()
    if clean[0] and clean[1]:
        lexicon.k = round(float(clean[0]) / float(clean[1]), 9)
    ev = rows.select("toxic", evidence(lexicon).alias("e")).where("toxic = 1 or e > 0")
    q = ev.where("e > 0").agg(F.percentile_approx("e", [i / 60 for i in range(61)], 10_000)).first()[0]
    cuts = sorted({c for c in q or [] if c > 0})
    cuts = sorted({*cuts, *((a + b) / 2 for a, b in zip([0.0, *cuts], cuts))})
    if cuts:
        costs = ev.agg(*[F.sum(F.when((F.col("toxic") == 1) != (F.col("e") >= c), 1).otherwise(0)) for c in cuts]).first()
        least = min(costs)
        ok = [c for c, cost in zip(cuts, costs) if cost == least]
        lexicon.cut = round(ok[len(ok) // 2], 9)
    release(rows)
    return lexicon


def score_column(lexicon: Lexicon, threshold: float = THRESHOLD):
    """0 without evidence, ``threshold`` at the cut, towards 1 beyond it."""
    x = F.col("evidence") / F.lit(lexicon.cut)
    return F.when(x >= 1, 1 - (1 - threshold) * F.exp(1 - x)).otherwise(F.least(x * threshold, F.lit(threshold - 1e-9)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> tuple[DataFrame, Lexicon]:
    """``doc_id, held_out, score, predicted, n_segments`` of every row, and the
    model. ``labels`` has ``doc_id`` and ``toxic``; of these only rows whose id is
    not held out are learned from.

    Null and empty texts have no words and score 0. Repeated rows and null ids
    keep their rows; an empty table gives no rows; other columns are ignored."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where(~held_out(F.col("doc_id"), 3, 1))
    lexicon = learn(d, training_rows(lab))
    scanned = materialize(scan(d, lexicon), "toxic-segments")
    lexicon = calibrate(scanned, lab, lexicon)
    out = scanned.withColumn("evidence", evidence(lexicon)).withColumn("score", score_column(lexicon, threshold))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"),
                      F.size("segments").cast("long").alias("n_segments")), lexicon
