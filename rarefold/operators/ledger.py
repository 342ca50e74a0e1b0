"""Experiment ledger (A9, K1-K4): a partitioned parquet table
``(run, test_number, metric, value)`` in the shared folder.

Appends overwrite only their own ``(run, test_number)`` partitions, so a fold
that is re-run replaces its rows and a crashed run resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = "run STRING, test_number INT, metric STRING, value DOUBLE"


def append(scores: DataFrame, path: str) -> None:
    """Write score rows; dynamic partition overwrite keeps it idempotent."""
    (scores.select("run", F.col("test_number").cast("int"), "metric",
                   F.col("value").cast("double"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "test_number").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, or an empty one if nothing was written yet."""
    try:
        return (spark.read.schema(LEDGER_SCHEMA).parquet(path)
                .select("run", "test_number", "metric", "value"))
    except Exception as e:  # noqa: BLE001 - path not created yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], LEDGER_SCHEMA)
        raise


def run_grid(runs: DataFrame, n_folds_col: str = "n_folds") -> DataFrame:
    """K3: planned ``(run, test_number)`` for every run and each of its folds."""
    folds = F.sequence(F.lit(0), F.col(n_folds_col).cast("int") - 1)
    return runs.select("run", F.explode(folds).alias("test_number"))


def experiment_runs(classifiers: list[str], datasets: DataFrame) -> DataFrame:
    """K3: every classifier on every ``(embedding, n_folds)``, named as B4 does."""
    from ..functions.scalars import shallow_run_name
    d = datasets.withColumn("classifier", F.explode(F.array(*[F.lit(c) for c in classifiers])))
    return d.select("classifier", "embedding", shallow_run_name(F.col("classifier"), F.col("embedding")).alias("run"),
                    "n_folds")


def pending(planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """K1: planned folds with no score yet (one anti-join, not a query per fold)."""
    done = ledger.select("run", "test_number").distinct()
    return planned.join(done, on=["run", "test_number"], how="left_anti")


def finished_runs(ledger: DataFrame, runs: DataFrame, n_folds_col: str = "n_folds") -> DataFrame:
    """K2: a run is finished when its own last fold is scored (not a fixed 49)."""
    last = ledger.groupBy("run").agg(F.max("test_number").alias("max_fold"))
    return runs.join(last, on="run", how="left").select(
        "run", "max_fold",
        F.coalesce(F.col("max_fold") == F.col(n_folds_col) - 1, F.lit(False)).alias("finished"))


def summary(ledger: DataFrame) -> DataFrame:
    """K4: mean and sample standard deviation per (run, metric), by metric."""
    return (ledger.groupBy("run", "metric")
            .agg(F.avg("value").alias("avg"), F.stddev_samp("value").alias("stddev"))
            .orderBy("run", "metric"))
