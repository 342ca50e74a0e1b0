"""Filter interaction audit: what each filter does in every order of filters.

A document's failures are a mask, one bit a filter. In an order of the filters a
step's outcome depends on the mask alone, so every mask is mapped once to a big
integer, a row of fixed-width fields: for each step of each order whether the
document is kept after it, removed by it, or fails a filter that an earlier one
made redundant, and, for labelled documents, whether a good or a toxic one is
lost. Adding such integers adds all fields at once, and a field of ``FIELD_BITS``
bits holds a sum over 2^FIELD_BITS - 1 documents, so nothing runs over into the
next field. Tasks add the integers of their rows by part, one more task a part
adds their sums, and the fields are unpacked at the end.

Exact duplicates need the whole table. Equal texts fail the same other filters,
so rows are first added up per content (SHA-256 of the whole text), part and
labels: a group of copies is a few rows however large it is, and only then meet
those of one content.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_dir

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
FIELD_BITS = 64
#: Parts whose sums a task holds; a field row is about 24 KB.
HELD_PARTS = 1024
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
_UPPER = bytes(range(65, 91))
_SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: bytes, n_chars: int) -> int:
    """The mask of filters A to D that the UTF-8 text of ``n_chars`` code points fails."""
    words = text.split()             # of bytes: parted by \x20 and \x09-\x0D
    upper = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1 \
        | (100 * upper > MOST_UPPER * n_chars) << 2 | (_SIGNS.search(text) is not None) << 3


def _measure(batches):
    for b in batches:
        mask, digest = [], []
        for t in b["text"].to_pylist():
            raw = (t or "").encode()
            mask.append(failures(raw, len(t or "")))
            digest.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["part"], pa.array(digest, pa.binary()), pa.array(mask, pa.int32())],
            names=["doc_id", "part", "digest", "mask"])


def packed(code: int) -> int:
    """The big integer of a mask with label bits: field ((order * 5 + step) * 5 +
    count), lowest first."""
    fields = np.zeros((len(ORDERS), len(FILTERS), len(COUNTS)), "<u8")
    for o, order in enumerate(ORDERS):
        alive = True
        for s, f in enumerate(order):
            fails = bool(code >> FILTERS.index(f) & 1)
            gone = alive and fails
            fields[o, s] = (alive and not fails, gone, fails and not alive, gone and code & GOOD != 0, gone and code & TOXIC != 0)
            alive &= not fails
    return int.from_bytes(fields.tobytes(), "little")


_FIELDS = len(ORDERS) * len(FILTERS) * len(COUNTS)


def unpack(total: int) -> np.ndarray:
    """Orders x steps x counts of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(_FIELDS * FIELD_BITS // 8, "little"), "<u8").reshape(
        len(ORDERS), len(FILTERS), len(COUNTS)).astype(np.int64)


def _sums(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held, pa.string()), pa.array([v.to_bytes(_FIELDS * FIELD_BITS // 8, "little") for v in held.values()],
                                               pa.binary())], names=["part", "total"])


def _add_rows(batches):
    """(part, code, n) to a task's big-integer sums by part."""
    table: dict[int, int] = {}
    held: dict[str, int] = {}
    for b in batches:
        for part, code, n in zip(*(b[c].to_pylist() for c in ("part", "code", "n"))):
            if code not in table:
                table[code] = packed(code)
            if part not in held and len(held) >= HELD_PARTS:
                yield _sums(held)
                held = {}
            held[part] = held.get(part, 0) + n * table[code]
    if held:
        yield _sums(held)


def _add_sums(batches):
    """Tasks' sums, sorted by part, to one row per part, order and step."""
    part, total = None, 0
    for b in batches:
        for own, value in zip(b["part"].to_pylist(), b["total"].to_pylist()):
            if own != part:
                if part is not None:
                    yield _steps(part, total)
                part, total = own, 0
            total += int.from_bytes(value, "little")
    if part is not None:
        yield _steps(part, total)


def _steps(part: str, total: int) -> pa.RecordBatch:
    counts = unpack(total)
    removed = counts[:, :, COUNTS.index("removed")]
    at = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    shapley = np.array([removed[at == f].sum() for f in range(len(FILTERS))])
    # what the last filter of an order removes fails no other one
    unique = np.array([removed[at[:, -1] == f, -1][0] for f in range(len(FILTERS))])
    cols = {"part": [part] * at.size, "filter_order": np.repeat(ORDERS, len(FILTERS)).tolist(),
            "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))}
    cols |= {c: counts[:, :, i].ravel() for i, c in enumerate(COUNTS)}
    cols |= {"unique_fails": unique[at].ravel(), "shapley": shapley[at].ravel()}
    return pa.RecordBatch.from_pydict(cols)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """``part, code, n``: documents by part and mask (with label bits)."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", "text").mapInArrow(
        _measure, "doc_id long, part string, digest binary, mask int")
    # repeated rows are one row with a count before they meet the labels
    rows = materialize(rows.groupBy("doc_id", "part", "digest", "mask").count(), "audit-rows")
    own = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    bit = lambda c, b: F.when(F.col(c), F.lit(b)).otherwise(F.lit(0))
    known = rows.where("doc_id IS NOT NULL").join(own, "doc_id", "left").withColumn(
        "code", F.col("mask") + bit("good", GOOD) + bit("toxic", TOXIC))
    rows = known.select("doc_id", "part", "digest", "code", "count").unionByName(
        rows.where("doc_id IS NULL").withColumn("code", F.col("mask")).select("doc_id", "part", "digest", "code", "count"))
    # per content, part and code: rows, the least id, and the rows that have it
    by_id = rows.groupBy("digest", "part", "code").agg(
        F.sum("count").alias("n"), F.min("doc_id").alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("count")).otherwise(0)).alias("without"),
        F.min_by("count", "doc_id").alias("n_least"))
    same = Window.partitionBy("digest")
    first = F.when(F.col("least") == F.min("least").over(same), F.col("n_least")).otherwise(0) + F.col("without")
    split = by_id.withColumn("first", first)
    copy = 1 << FILTERS.index("E")
    return split.select("part", F.explode(F.array(
        F.struct(F.col("code").alias("code"), F.col("first").cast("long").alias("n")),
        F.struct((F.col("code") + copy).alias("code"), (F.col("n") - F.col("first")).cast("long").alias("n")))).alias("x")
    ).select("part", "x.code", "x.n").where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with its counts.

    Defined cases: a null text is an empty one and a null part the empty string;
    a row without an id has no labels, fails E never and makes no other row fail
    it; rows that share the least id of their text are all first (E asks for a
    smaller id); an id with several label rows has each label that one of them
    has; an empty table gives no rows; other columns are ignored."""
    sums = masks(docs, labels, id_col, text_col, part_col).mapInArrow(_add_rows, "part string, total binary")
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(
        _add_sums, "part string, filter_order string, step int, kept long, removed long, redundant long, good_lost long, "
                   "toxic_lost long, unique_fails long, shapley long")
