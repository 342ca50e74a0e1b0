"""Scalar expressions (B1-B7, B9-B11), all built-in and codegen-friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (whitespace per
# str.isspace), as a regex class valid in Java and RE2 alike.
PY_SPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
STRIP_PATTERN = rf"^{PY_SPACE}+|{PY_SPACE}+$"
# Line ends of Python's universal-newline text mode.
LINE_BREAK = "\r\n|\r|\n"
# Suffixes of the four deep-run variants: plain, balanced sampling, weighted
# loss, both.
RUN_SUFFIXES = ["", "_bs", "_wce", "_bs_wce"]


def strip(c: Column) -> Column:
    """B1: ``str.strip()`` (Unicode blanks, not only spaces)."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def binarise(c: Column, positive: str = "1") -> Column:
    """B2: 1 when the stripped text equals ``positive``, else 0."""
    return F.when(strip(c.cast("string")) == F.lit(positive), 1).otherwise(0)


def basename(c: Column) -> Column:
    """Text after the last '/'."""
    return F.substring_index(c, "/", -1)


def run_name(model: Column, suffix: str = "") -> Column:
    """Table name of a run: drop up to the first '/', '-' -> '_', no '.'."""
    pos = F.instr(model, "/")
    cut = F.when(pos > 0, model.substr(pos + 1, F.lit(1 << 30))).otherwise(model)
    return F.concat(F.replace(F.replace(cut, F.lit("-"), F.lit("_")), F.lit("."), F.lit("")),
                    F.lit(suffix))


def shallow_run_name(classifier: Column, embedding: Column) -> Column:
    return F.concat_ws("_", classifier, embedding)


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def positive_proba(p: Column) -> Column:
    """Probability of class 1 from a per-class probability array."""
    return F.element_at(p, 2)


def hstack(*arrays: Column) -> Column:
    """Horizontal feature concat in one projection."""
    return F.concat(*arrays)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linear_map(matrix_rows: list[list[float]], x: Column) -> Column:
    """``L @ x`` for a small literal ``L`` (one SQL lambda per output).

    Wide maps go through ``operators.lmnn.apply_map`` (Arrow + NumPy)."""
    lit = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix_rows])
    return F.transform(lit, lambda row: dot(row, x))


def log_softmax_at(z: Column, y: Column) -> Column:
    """log softmax(z)[y] with log-sum-exp shifted by the max."""
    m = F.array_max(z)
    lse = m + F.log(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - m)))
    return F.element_at(z, y + 1) - lse
