"""Input bindings over the driver tables, stated once in Spark and once in SQL.

``vec_bin``  : embeddings, label 3 against the rest (64-d vectors).
``text_bin`` : documents joined with labels, ``toxic`` as the label, ``source``
               as the leave-one-group-out group.
``scored``   : text_bin with a fixed, tie-heavy score derived from the length.
``logits``   : vec_bin with two class scores (``class_scores`` of the whole vector).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vec_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    (F.col("label") == 3).cast("int").alias("label"))


def text_bin(spark: SparkSession, sf_dir: str, with_len: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    cols = [F.col("doc_id").alias("id"), "text", F.col("source").alias("grp"),
            F.col("toxic").cast("int").alias("label")]
    if with_len:
        cols.append("n_chars")
    return d.join(lab, on="doc_id", how="inner").select(*cols)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text_bin(spark, sf_dir, with_len=True).drop("text")
    proba = F.round(F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0)), 2)
    return t.withColumn("proba", proba).withColumn("pred", (F.col("proba") > 0.3).cast("int"))


def class_scores(features: Column, k: int) -> Column:
    """``k`` scores from a whole vector: score c sums the entries c, c + k, c + 2k, ..."""
    own = lambda c: F.filter(features, lambda v, i: i % k == c)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.round(
        F.aggregate(own(c), F.lit(0.0), lambda s, v: s + v), 9))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vec_bin(spark, sf_dir)
    return v.withColumn("logits", class_scores(F.col("features"), 2))


# ---- the same bindings for the DuckDB oracle -------------------------------

SQL_VEC_BIN = """vec_bin AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features,
         CAST(label = 3 AS INTEGER) AS label FROM embeddings)"""

SQL_TEXT_BIN = """text_bin AS (
  SELECT d.doc_id AS id, d.text, d.source AS grp, CAST(l.toxic AS INTEGER) AS label,
         d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SQL_SCORED = SQL_TEXT_BIN + """,
scored AS (
  SELECT id, grp, label, n_chars, round(least(n_chars / 8000.0, 1.0), 2)::DOUBLE AS proba,
         CAST(round(least(n_chars / 8000.0, 1.0), 2) > 0.3 AS INTEGER) AS pred
  FROM text_bin)"""

def sql_class_scores(features: str, k: int) -> str:
    return (f"list_transform(range(0, {k}), lambda c: round(list_sum(list_transform(range(c, len({features}), {k}), "
            f"lambda i: {features}[i + 1])), 9))")


SQL_LOGITS = SQL_VEC_BIN + f""",
logits AS (SELECT *, {sql_class_scores('features', 2)} AS logits FROM vec_bin)"""


def sql_hash(*parts: str) -> str:
    """DuckDB form of ``functions.seeded.hash_hex`` (parts are SQL expressions)."""
    return f"md5(concat_ws(':', {SEED}, {', '.join(parts)}))"


def sql_uniform(*parts: str) -> str:
    return f"(('0x' || substr({sql_hash(*parts)}, 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
