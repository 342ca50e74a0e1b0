"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches as text_batches  # noqa: F401 - what goes to Python at a time

BROADCAST_HOT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other alphabets too)."""
    return F.translate(c, UPPER, LOWER)


def broadcast_within(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; beyond
    that the join shuffles both sides. ``rows`` is the counted size."""
    return F.broadcast(df) if rows <= most else df


def nulls_apart(key: Column, row_id: Column) -> Column:
    """A string join key whose null rows get values of their own that match
    nothing, so an outer join does not send all of them to one task."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")),
                      F.concat(F.lit("n"), F.xxhash64(row_id).cast("string")))


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of a row's id and text: alike rows share it, and rows that
    share an id but not a text, or have no id, do not."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part(id_col), F.lit("\n"), part(text_col)))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one join key that a task may take.
SPREAD_ROWS = 1 << 18


def hot_keys(df: DataFrame, key: list[str]) -> list[tuple]:
    """The keys with more than ``SPREAD_ROWS`` rows and the salts that each asks
    for: at most one key in ``SPREAD_ROWS`` rows of the table."""
    counts = df.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return [(*r[:-1], -(-r[-1] // SPREAD_ROWS)) for r in counts.where(F.col("_n") > SPREAD_ROWS).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: list[str], by: list[str], how: str = "inner",
                hot: list[tuple] | None = None) -> DataFrame:
    """``left.join(right, key, how)`` where one key may have a third of the rows
    of ``left`` (and few of ``right``). The left rows of a hot key (``hot``, else
    counted here, so ``left`` should be a written table) are dealt over as many
    salts, by a hash of ``by``, as tasks should share them, and its right rows go to
    each salt."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    schema = ", ".join([*(f"{k} {left.schema[k].dataType.simpleString()}" for k in key), "_salts int"])
    salts = F.coalesce("_salts", F.lit(1))

    def with_salts(df: DataFrame, salt: Column) -> DataFrame:
        own = broadcast_within(left.sparkSession.createDataFrame(hot, schema), len(hot), BROADCAST_HOT)
        return df.join(own, key, "left").withColumn("_salt", salt).drop("_salts")

    dealt = with_salts(left, F.pmod(F.xxhash64(*by), salts).cast("int"))
    copied = with_salts(right, F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copied, [*key, "_salt"], how).drop("_salt")
