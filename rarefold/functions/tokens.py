"""Tokenisation (B8) and the batched row-function map.

Word tokens are maximal runs of letters and digits of the lower-cased text,
in every script (``[^\\p{L}\\p{N}]+`` separates them; ``\\W`` would cut words
at accented letters). Token ids are md5 buckets so an oracle can restate them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_PATTERN = r"[^\p{L}\p{N}]+"
PAD_ID = 0


def tokens(text: Column) -> Column:
    """Whole-text word tokens (no empty strings)."""
    return F.filter(F.split(F.lower(text), SPLIT_PATTERN, -1), lambda t: t != "")


def token_bucket(tok: Column, vocab: int) -> Column:
    """1 + md5 bucket in [1, vocab]; 0 is the padding id."""
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint") % vocab + 1


def token_ids(text: Column, vocab: int) -> Column:
    return F.transform(tokens(text), lambda t: token_bucket(t, vocab))


def fixed_length(toks: Column, vocab: int, max_len: int) -> tuple[Column, Column]:
    """truncate/pad to ``max_len`` model inputs and the attention mask; only
    the tokens that are kept are hashed."""
    n = F.size(toks)
    head = F.transform(F.slice(toks, 1, max_len), lambda t: token_bucket(t, vocab))
    pad = F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.greatest(F.lit(0), F.lit(max_len) - n))
    mask = F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: (i <= n).cast("int"))
    return F.concat(head, pad), mask


def _py_ids(text: str | None, vocab: int) -> list[int]:
    import regex
    if text is None:
        return []
    toks = [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]
    return [int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % vocab + 1 for t in toks]


def arrow_token_map(df: DataFrame, text_col: str = "text", id_col: str = "id",
                    vocab: int = 32768) -> DataFrame:
    """A row function applied to Arrow batches (``mapInArrow``): the
    user-function surface of the reference (a batched tokeniser)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(id_col).to_pylist()
            texts = b.column(text_col).to_pylist()
            toks = [_py_ids(t, vocab) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in toks], pa.int32()),
                 pa.array(toks, pa.list_(pa.int64()))],
                names=["id", "n_tokens", "token_ids"])

    return df.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(
        fn, "id long, n_tokens int, token_ids array<long>")
