"""Pluggable text encoders (F1, F2) and a content-keyed vector store.

An encoder turns an Arrow batch of texts into vectors. There are two kinds, and
``vectorise`` takes either for any number of folds:

* a frozen encoder (``Encoder``) does not look at the training rows. Its
  ``open`` is called once per Python worker and returns a function of a list of
  texts; every distinct text is encoded once, ever: vectors are kept in a store
  under the SHA-256 of the text, and only texts that the store lacks are encoded.
* ``Tfidf`` is fitted on the training side of every fold. Terms are counted once
  per text; a fold's IDF makes its vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import SPLIT_PATTERN
from ..session import materialize, scratch_path
from . import textfeat

#: Texts handed to an encoder at a time.
BATCH_TEXTS = 256


class Encoder:
    """A frozen encoder. ``name`` names its vectors in a store (so it must tell
    versions apart), ``dim`` is their length; subclasses give ``open``."""

    name: str
    dim: int

    def open(self) -> Callable[[list[str]], np.ndarray]:
        """Load what the encoder needs; the function gives n x dim numbers."""
        raise NotImplementedError


@dataclass(frozen=True)
class SignedWords(Encoder):
    """Signed hashing of words: each word adds +1 or -1 to one of ``dim`` places,
    both told by its MD5; vectors have length 1 (of a text without words: 0)."""

    dim: int = 256

    @property
    def name(self) -> str:
        return f"signed-words-{self.dim}"

    def open(self) -> Callable[[list[str]], np.ndarray]:
        import regex
        words = regex.compile(SPLIT_PATTERN)
        known: dict[str, tuple[int, float]] = {}

        def place(w: str) -> tuple[int, float]:
            h = hashlib.md5(w.encode()).hexdigest()
            return int(h[:8], 16) % self.dim, 1.0 if int(h[8], 16) < 8 else -1.0

        def encode(texts: list[str]) -> np.ndarray:
            if len(known) > 200_000:
                known.clear()
            out = np.zeros((len(texts), self.dim))
            for i, t in enumerate(texts):
                for w in words.split(t.lower()):
                    if w:
                        if w not in known:
                            known[w] = place(w)
                        at, sign = known[w]
                        out[i, at] += sign
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return out / np.where(norm > 0, norm, 1.0)
        return encode


@dataclass(frozen=True)
class Tfidf:
    """Hashed TF-IDF, the IDF fitted on each fold's training side."""

    dim: int = 1024


def _text_key(c: str):
    return F.sha2(F.coalesce(F.col(c), F.lit("")), 256)


def _opened(encoder: Encoder):
    """``key, text`` to ``key, features``; the encoder is opened once per worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            for i in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(i, BATCH_TEXTS)
                encode = encode or worker_encoder(encoder)
                v = np.ascontiguousarray(encode([t or "" for t in part.column(1).to_pylist()]), dtype=np.float64)
                if v.shape != (part.num_rows, encoder.dim):
                    raise ValueError(f"{encoder.name}: {v.shape} numbers for {part.num_rows} texts of {encoder.dim}")
                flat = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), encoder.dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["key", "features"])
    return run


_WORKER: dict[str, Callable] = {}


def worker_encoder(encoder: Encoder) -> Callable[[list[str]], np.ndarray]:
    """The opened encoder of this Python worker, which Spark uses for many tasks."""
    if encoder.name not in _WORKER:
        _WORKER[encoder.name] = encoder.open()
    return _WORKER[encoder.name]


def read_store(spark: SparkSession, store: str, encoder: Encoder) -> DataFrame:
    """``key, features`` of the texts that were encoded before."""
    schema = "key string, features array<double>, encoder string"
    try:
        kept = spark.read.schema(schema).parquet(store)
    except Exception as e:  # noqa: BLE001 - nothing was stored yet
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        kept = spark.createDataFrame([], schema)
    return kept.where(F.col("encoder") == encoder.name).select("key", "features")


def encode(texts: DataFrame, encoder: Encoder, store: str | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, features`` of every row. Each distinct text that ``store`` (default: a
    fresh one) lacks is encoded once and added to it; null texts are empty ones."""
    spark = texts.sparkSession
    store = store or scratch_path(spark, "vectors")
    keyed = texts.select(F.col(id_col).alias("id"), _text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    # one text of each key: partial aggregation drops copies before the shuffle
    new = keyed.groupBy("key").agg(F.first("text").alias("text")).join(read_store(spark, store, encoder).select("key"), "key", "left_anti")
    (new.mapInArrow(_opened(encoder), "key string, features array<double>").withColumn("encoder", F.lit(encoder.name))
        .write.mode("append").partitionBy("encoder").parquet(store))
    return keyed.select("id", "key").join(read_store(spark, store, encoder), "key").select("id", "features")


def vectorise(texts: DataFrame, folds: DataFrame, encoder: Encoder | Tfidf, store: str | None = None) -> DataFrame:
    """F1 (one fold) and F2 (many) by any encoder: ``repeat, split, id, label,
    features`` of the rows of ``folds`` (repeat, split, id, label). A text without
    terms has the zero vector."""
    sides = folds.select("repeat", "split", "id", "label")
    if isinstance(encoder, Tfidf):
        sparse = textfeat.vectorise_folds(texts, sides, encoder.dim)
        vectors = textfeat.dense(sparse.select("repeat", "id", "term", "weight"), encoder.dim, ["repeat", "id"])
        out = sides.join(vectors, ["repeat", "id"], "left")
    else:
        out = sides.join(materialize(encode(texts, encoder, store), "encoded"), "id", "left")
    zero = F.array_repeat(F.lit(0.0), encoder.dim)
    return out.select("repeat", "split", "id", "label", F.coalesce("features", zero).alias("features"))
