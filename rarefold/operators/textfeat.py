"""Text -> features (F1, F2): hashed TF-IDF, IDF fitted on training rows only.

A document is one row from its text to its vector: its tokens are counted inside
the task that reads it, its terms travel as arrays, and only the results are a
row per (document, term). No table of tokens or of (document, term) pairs is ever
shuffled, sorted or aggregated, so a task holds a batch of documents at most.
The IDF has at most ``n_features`` numbers (per fold). Each document is
L2-normalised over its own terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tokens import tokens
from ..session import materialize, release, row_join, small_batches, spread


#: List entries that a worker takes at a time (one longer list goes by itself), and distinct tokens whose hash it remembers.
TAKEN, MEMO_TOKENS = 1 << 19, 1 << 16


@lru_cache(MEMO_TOKENS)
def _bucket(token: bytes) -> int:
    return int(hashlib.md5(token).hexdigest()[:8], 16)


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` with at most ``TAKEN`` entries in the column ``lists``."""
    for b in batches:
        until, first = np.cumsum(lengths(b.column(lists))), 0
        while first < b.num_rows:
            before = until[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(until, before + TAKEN, side="right")))
            yield b.slice(first, last - first)
            first = last


def _lists(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype())))


def term_lists(df: DataFrame, n_features: int, text_col: str = "text", keep: Sequence[str] = ("id",)) -> DataFrame:
    """``keep, terms array<int>, counts array<bigint>`` of every row (empty without a token):
    term = md5 bucket of the token in [0, n_features), in rising order. One map pass."""
    small_batches(df.sparkSession)
    src = spread(df.select(*keep, text_col), keep[0])      # tokenising is the CPU-heavy step
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("terms", T.ArrayType(T.IntegerType())),
                                                          T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, len(keep)):
            lists = b.column(len(keep))
            tokens_ = lists.flatten().dictionary_encode()
            kind = pa.large_binary() if pa.types.is_large_string(tokens_.dictionary.type) else pa.binary()
            term = np.array([_bucket(t) % n_features for t in tokens_.dictionary.cast(kind).to_pylist()], np.int64)
            of = np.repeat(np.arange(b.num_rows), lengths(lists))
            pair = of * n_features + term[tokens_.indices.to_numpy()]
            if b.num_rows * n_features <= 2 * TAKEN:       # counted in place
                n = np.bincount(pair, minlength=b.num_rows * n_features)
                pair = np.flatnonzero(n)
                n = n[pair]
            else:
                pair, n = np.unique(pair, return_counts=True)
            lens = np.bincount(pair // n_features, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], _lists(pair % n_features, lens, pa.int32()), _lists(n, lens, pa.int64())],
                names=[*keep, "terms", "counts"])

    return src.select(*keep, tokens(F.col(text_col)).alias("_toks")).mapInArrow(run, schema)


def repeated_ids(rows: DataFrame, id_col: str = "id") -> DataFrame | None:
    """The ids (``_again``, written) that several of the written ``rows`` have; None without any."""
    again = materialize(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_col).alias("_again")), "repeated-ids")
    if not again.isEmpty():
        return again
    release(again)
    return None


def add_up(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, terms, counts``: the counts of all rows of an id, by term."""
    per = rows.select(id_col, F.explode(F.arrays_zip("terms", "counts")).alias("_x"))
    per = per.groupBy(id_col, F.col("_x.terms").alias("t")).agg(F.sum("_x.counts").alias("n"))
    per = per.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("_x"))     # n_features entries at most
    return per.select(id_col, F.col("_x.t").alias("terms"), F.col("_x.n").alias("counts"))


def term_counts(df: DataFrame, n_features: int, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """``id, terms array<int>, counts array<bigint>``: one (written) row per id with a
    token. Ids are looked through alone; only rows of repeated ids meet, added up by term."""
    own = materialize(term_lists(df, n_features, text_col, [id_col]).where(F.size("terms") > 0), "term-counts")
    again = repeated_ids(own, id_col)
    if again is None:
        return own
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    out = materialize(own.join(again, same, "left_anti").unionByName(add_up(own.join(again, same, "left_semi"), id_col)), "term-counts")
    release(own, again)
    return out


def fit_idf(counts_train: DataFrame, n_docs: DataFrame | int) -> DataFrame:
    """(term, idf) with the smoothed form ln((1 + N) / (1 + df)) + 1 over the
    training documents (``term_counts`` rows); terms unseen in training get no column."""
    # a document names a term once: a count is the document frequency, with
    # map-side partial counts even for terms in every document
    df_ = counts_train.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return df_.select("term", (F.log((1 + n) / (1 + F.col("_df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, idf: DataFrame, n_features: int, id_col: str = "id") -> DataFrame:
    """(id, term, weight), L2-normalised per document, of ``term_counts`` rows."""
    known = np.full(n_features, np.nan)
    for r in idf.collect():                                    # n_features rows at most
        known[r["term"]] = r["idf"]
    bc = counts.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([counts.schema[id_col], T.StructField("term", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 1):
            row = np.repeat(np.arange(b.num_rows), lengths(b.column(1)))
            term = b.column(1).flatten().to_numpy(zero_copy_only=False)
            w = b.column(2).flatten().to_numpy(zero_copy_only=False) * bc.value[term]
            in_train = ~np.isnan(w)
            row, term, w = row[in_train], term[in_train], w[in_train]
            norm = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(term.astype(np.int32)), pa.array(w / norm[row])],
                                             names=[id_col, "term", "weight"])

    return counts.select(id_col, "terms", "counts").mapInArrow(run, schema)


def dense(sparse: DataFrame, dim: int, keys: list[str]) -> DataFrame:
    """``keys`` and ``features`` from ``keys, term, weight`` rows: a row's terms are
    placed in its vector by NumPy."""
    rows = sparse.groupBy(*keys).agg(F.collect_list("term").alias("_t"), F.collect_list("weight").alias("_w"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            lens = pc.list_value_length(t.column("_t")).to_numpy()
            out = np.zeros((b.num_rows, dim))
            out[np.repeat(np.arange(b.num_rows), lens), t.column("_t").combine_chunks().flatten().to_numpy(zero_copy_only=False)] \
                = t.column("_w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], flat], names=[*keys, "features"])

    return rows.select(*keys, "_t", "_w").mapInArrow(run, f"{kinds}, features array<double>")


def to_dense(sparse: DataFrame, n_features: int, id_col: str = "id",
             out: str = "features") -> DataFrame:
    """Dense ``array<double>`` per document (at most n_features entries each)."""
    return dense(sparse, n_features, [id_col]).withColumnRenamed("features", out)


def vectorise(train: DataFrame, rows: DataFrame, n_features: int = 1024,
              text_col: str = "text", id_col: str = "id") -> DataFrame:
    """fit on ``train`` (a subset of ``rows``), transform ``rows``: sparse
    (id, term, weight). Texts are tokenised once: the counted documents are
    written to the shared folder and read by both the IDF fit (a semi-join with
    the training ids) and the weighting."""
    counts = term_counts(rows, n_features, text_col, id_col)
    counts_train = row_join(counts, train.select(id_col), id_col, "left_semi")
    n = train.select(F.count(F.lit(1))).scalar()
    return tfidf(counts, fit_idf(counts_train, n), n_features, id_col)


def fold_frequencies(rows: DataFrame, n_features: int, fold_col: str = "repeat") -> DataFrame:
    """(fold, term, _df): how many of ``rows`` (``_folds``: the folds that train on the
    row, each as often as it comes; ``terms``) name a term, by fold. A row meets its
    folds inside the task, which adds up folds x n_features numbers."""
    kind = rows.schema["_folds"].dataType.elementType
    schema = T.StructType([T.StructField(fold_col, kind), T.StructField("term", T.IntegerType()), T.StructField("_df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in _parts(batches, 1):
            folds = b.column(0).flatten().dictionary_encode()
            at = folds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), lengths(b.column(0)))
            lens, term = lengths(b.column(1)), b.column(1).flatten().to_numpy(zero_copy_only=False)
            for k, fold in enumerate(folds.dictionary.to_pylist()):
                times = np.repeat(np.bincount(of[at == k], minlength=b.num_rows), lens)
                own = np.bincount(term, times, minlength=n_features).astype(np.int64)
                sums[fold] = sums[fold] + own if fold in sums else own
        for fold, own in sums.items():
            term = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(term), to_arrow_type(kind)), pa.array(term.astype(np.int32)), pa.array(own[term])],
                                             names=[fold_col, "term", "_df"])

    per = rows.select("_folds", "terms").mapInArrow(run, schema)
    return per.groupBy(fold_col, "term").agg(F.sum("_df").alias("_df"))


def fold_idf(counts: DataFrame, folds: DataFrame, n_features: int, fold_col: str = "repeat", id_col: str = "id") -> DataFrame:
    """(fold, term, idf) over each fold's train rows: folds x n_features rows at most."""
    tr = folds.filter(F.col("split") == "train").select(fold_col, id_col)
    n_train = tr.groupBy(fold_col).agg(F.count(F.lit(1)).alias("_n"))
    of = tr.groupBy(id_col).agg(F.collect_list(fold_col).alias("_folds"))
    return idf_of(fold_frequencies(row_join(counts, of, id_col), n_features, fold_col), n_train, fold_col)


def idf_of(frequencies: DataFrame, n_train: DataFrame, fold_col: str = "repeat") -> DataFrame:
    """(fold, term, idf) from document frequencies and each fold's number of train rows."""
    return frequencies.join(F.broadcast(n_train), on=fold_col, how="inner").select(       # a row per fold
        fold_col, "term", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"))


def vectorise_folds(docs: DataFrame, folds: DataFrame, n_features: int = 1024,
                    fold_col: str = "repeat", text_col: str = "text",
                    id_col: str = "id") -> DataFrame:
    """every fold at once. Text is tokenised and counted once per
    document; only the IDF depends on the fold (train rows of that fold)."""
    counts = term_counts(docs, n_features, text_col, id_col)               # read twice
    rows: dict = {}
    for r in fold_idf(counts, folds, n_features, fold_col, id_col).collect():              # folds x n_features numbers at most
        rows.setdefault(r[fold_col], [None] * n_features)[r["term"]] = r["idf"]
    schema = T.StructType([folds.schema[fold_col], T.StructField("_idf", T.ArrayType(T.DoubleType()))])
    idf = docs.sparkSession.createDataFrame([(k, v) for k, v in rows.items() if k is not None], schema)
    # a document's terms stay one row in every fold, so no row per (fold, document, term) is sorted or dealt
    terms = counts.select(id_col, F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf")).alias("_t"))
    sides = folds.groupBy(fold_col, id_col).agg(F.collect_list("split").alias("_splits"))
    own = sides.join(terms.hint("merge"), on=id_col, how="inner").join(F.broadcast(idf), on=fold_col, how="inner")
    w = F.transform("_t", lambda x: F.struct(x["term"].alias("term"), (x["tf"] * F.get("_idf", x["term"])).alias("w")))
    own = own.withColumn("_t", F.filter(w, lambda x: x["w"].isNotNull()))
    # rows of a repeated id count as often as they come
    square = F.size("_splits") * F.aggregate("_t", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    own = own.select(fold_col, id_col, F.sqrt(square).alias("_norm"), "_t", F.explode("_splits").alias("split"))
    own = own.select(fold_col, "split", id_col, "_norm", F.explode("_t").alias("_x"))
    return own.select(fold_col, "split", id_col, F.col("_x.term").alias("term"), (F.col("_x.w") / F.col("_norm")).alias("weight"))
