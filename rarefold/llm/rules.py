"""Quality rules as a bitmask ledger.

``measure`` reads every whole text once and gives its counts. ``ledger`` adds
``fail_bits``: bit *i* is set where rule *i* fails. Policies are versioned sets
of rules, so a mask; applying one, or comparing versions, only tests bits of the
stored ledger and never reads a text again. ``ablation`` aggregates the ledger by
its few distinct bit patterns and tells, for each rule of a policy, how many
documents fail it, and how many would be kept if the rule were left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .words import chunks, mix

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper"]
WINDOW = 5

#: Rules in bit order: name, and SQL over the counts that is true where it fails.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("capitals", "n_letters >= 20 and 100 * n_upper > 40 * n_letters"),
]
BASE = ("few_words", "repeated_words")
#: Policies by version; a version never changes once it is in use.
POLICIES = {
    "base-1": BASE,
    "clean-1": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words", "capitals"),
}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _again(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: how often its key is in its document; whether it is the first."""
    with np.errstate(over="ignore"):
        both = mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inv, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(key), dtype=bool)
    is_first[first] = True
    return n[inv], is_first


def _counts(w) -> np.ndarray:
    """n_docs x COUNTS of one chunk."""
    out = np.zeros((w.n_docs, len(COUNTS)), dtype=np.int64)
    out[:, 0] = np.diff(w.at)
    d, ds = w.data, w.doc_start
    if not len(d):
        return out
    inside = np.zeros(len(d) + 1, dtype=np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside)[:-1] > 0
    out[:, 1] = _per_doc(in_word & ((d & 0xC0) != 0x80), ds)
    out[:, 2] = _per_doc(_SYMBOL[d], ds)
    out[:, 6] = _per_doc(_LETTER[d], ds)
    out[:, 7] = _per_doc(_UPPER[d], ds)
    # lines: cut at \n and at document ends; a line's hash is that of its bytes
    cut = np.flatnonzero(d == 0x0A)
    begin = np.unique(np.concatenate((ds[:-1], cut + 1)))
    begin = begin[begin < len(d)]
    stop = np.concatenate((begin[1:], [len(d)]))
    stop = np.where((stop > begin) & (d[np.maximum(stop - 1, 0)] == 0x0A), stop - 1, stop)
    line = w.span_hash(begin, stop)
    has_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    line, line_doc = line[has_word], np.searchsorted(ds, begin[has_word], side="right") - 1
    out[:, 5] = np.bincount(line_doc, minlength=w.n_docs)
    _, first = _again(line, line_doc)
    out[:, 3] = np.bincount(line_doc[~first], minlength=w.n_docs)
    # words in windows that the text has twice or more
    win, fits = w.windows(WINDOW)
    at = np.flatnonzero(fits)
    doc = np.repeat(np.arange(w.n_docs), np.diff(w.at))
    n, _ = _again(win[at], doc[at])
    cover = np.zeros(len(win) + 1, dtype=np.int64)
    np.add.at(cover, at[n > 1], 1)
    np.add.at(cover, at[n > 1] + WINDOW, -1)
    out[:, 4] = _per_doc(np.cumsum(cover)[:-1] > 0, w.at)
    return out


def _measure(batches):
    for b in batches:
        parts = [_counts(w) for w in chunks(b.column(1))]
        m = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m[:, i]) for i in range(len(COUNTS))]],
                                         names=["doc_id", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``COUNTS`` (long) of every row's whole text."""
    shared_dir(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _measure, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, and ``fail_bits`` (long).

    A null text has no words and no lines: it fails ``few_words`` only. Rows are
    judged one by one, so repeated rows and null ids keep their own rows; an
    empty table gives an empty ledger; other columns are ignored."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(RULES)])
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def mask(rules) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def fails(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """``rule, n_failed, n_only`` for each rule of the policy: documents that
    fail it, and those that fail no other rule of the policy. The ledger is
    first counted by bit pattern, of which there are at most 2^rules."""
    m = mask(POLICIES[policy])
    by = (ledger_rows.select(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
          .groupBy("bits").agg(F.count("*").alias("n")))
    names = [n for n, _ in RULES]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                                for r in POLICIES[policy]]))
    return (by.select("bits", "n", rules.alias("r")).groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only")))
