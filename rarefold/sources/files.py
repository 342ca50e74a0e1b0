"""Scans and sinks.

Files are read by Spark's own readers; the file name comes from the hidden
``_metadata`` column. Sinks write partitioned parquet so a fold or a vector
set is read back by partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import LINE_BREAK, binarise, strip
from ..session import materialize, row_join


def lines(df: DataFrame, file_col: str = "file", value_col: str = "value") -> DataFrame:
    """Split whole texts into numbered lines as Python's text iteration does:
    universal newlines, and no empty last line after a final line break."""
    # the parts are made below the explode: beside it, Spark would split the whole text for each line
    d = df.select(file_col, F.split(F.col(value_col), LINE_BREAK, -1).alias("_parts"))
    some = F.when(F.element_at("_parts", -1) == "", F.slice("_parts", 1, F.size("_parts") - 1)).otherwise(F.col("_parts"))
    return d.select(file_col, F.posexplode(some).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def pair_lines(sentences: DataFrame, label_lines: DataFrame, file_col: str = "file",
               value_col: str = "value", positive: str = "1",
               strict: bool = True) -> DataFrame:
    """A1 on whole texts: line n of a sentence text pairs with line n of its
    label text (``pair_numbered``)."""
    return pair_numbered(lines(sentences, file_col, value_col), lines(label_lines, file_col, value_col),
                         file_col, positive, strict)


def pair_numbered(sentences: DataFrame, label_lines: DataFrame, file_col: str = "file", positive: str = "1",
                  strict: bool = True) -> DataFrame:
    """A1: ``(file, line_no, line)`` of sentences and of labels, paired by an
    equi-join on file and line number. Text is stripped (B1), the label is
    1 when it reads ``positive`` (B2). With ``strict`` an unmatched line stops
    the job (the reference never compares the two lengths)."""
    s = sentences.select(
        file_col, "line_no", strip(F.col("line")).alias("text"))
    lab = label_lines.select(
        file_col, "line_no", binarise(F.col("line"), positive).alias("label"))
    j = s.join(lab, on=[file_col, "line_no"], how="full_outer")
    if strict:
        bad = F.col("text").isNull() | F.col("label").isNull()
        j = j.withColumn("label", F.when(bad, F.raise_error(F.concat(
            F.lit("sentence and label line counts differ in "), F.col(file_col))))
            .otherwise(F.col("label")))
    return j.withColumn("label", F.col("label").cast("int"))


#: Splits of files whose line counts go to every task.
BROADCAST_SPLITS = 200_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of every line of the files in ``path``, however
    large: Spark reads a file in splits, and a line's number is its place in its
    split plus the lines of the file's splits before. Breaks are those of Python's
    text iteration (\\n, \\r\\n, \\r; none is added at the end of a file)."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_i"))     # rises by one along a split
    splits = rows.groupBy("_path", "_at").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # written: a row per split, and what the hint below rests on
    splits = materialize(splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "splits")
    few = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    return rows.join(few, on=["_path", "_at"]).select(
        "file", (F.col("_i") - F.col("_first") + F.col("_off")).alias("line_no"), "line")


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """A3: every file as one string, with its base name (and the partition
    columns of a partitioned directory)."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.col("_metadata.file_name").alias("file"), "value",
                    *[c for c in d.columns if c != "value"])


def read_paired_files(spark: SparkSession, sentence_dir: str, label_dir: str,
                      strict: bool = True) -> DataFrame:
    """A1 over two directories whose files share names."""
    return pair_numbered(read_lines(spark, sentence_dir), read_lines(spark, label_dir), strict=strict)


def read_fold_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A4: columnar JSON ``{"text": [...], "labels": [...]}`` -> one row per
    position, position kept. ``multi_line`` reads one (possibly indented)
    object per file; ``False`` reads one object per line (chunked exports)."""
    raw = spark.read.json(path, multiLine=multi_line,
                          schema="text array<string>, labels array<int>")
    raw = raw.select(F.col("_metadata.file_path").alias("path"), "text", "labels")
    z = raw.select("path", F.posexplode(F.arrays_zip("text", "labels")).alias("pos", "r"))
    return z.select("path", F.col("pos").cast("bigint").alias("pos"),
                    F.col("r.text").alias("text"), F.col("r.labels").alias("label"))


def write_folds(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Every fold and split, overwriting; JSON output is one row per line."""
    (df.write.mode("overwrite").partitionBy("fold", "split").format(fmt).save(path))


#: Most output files that a task of ``write_fold_json`` has open at a time.
OPEN_FILES = 64


def write_fold_json(rows: DataFrame, sides: DataFrame, path: str, row_col: str, chunk_rows: int = 4096,
                    text_col: str = "text", label_col: str = "label", id_col: str = "id") -> None:
    """A7, columnar form: ``{"text": [...], "labels": [...]}`` objects, one per
    line (gzip), partitioned by (fold, split). ``sides`` (row, fold, split) names the
    folds of each row of ``rows``, which has its text once. A fold is cut into
    chunks of at most about ``chunk_rows`` rows by hash of the id, so no object (and
    no task) has to hold a whole fold; inside a chunk rows are in id order. Chunks
    are the same rows in all folds: texts are dealt to them once, not once for each
    fold, and a chunk's objects are made where its rows are."""
    keys = ["fold", "split"]
    most = sides.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    chunks = max(1, -(-most // chunk_rows))
    own = sides.groupBy(row_col).agg(F.collect_list(F.struct(*keys)).alias("_s"))        # a row's folds
    d = row_join(rows.select(row_col, F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(label_col).cast("int").alias("_y")),
                 own, row_col)
    g = d.groupBy(F.pmod(F.xxhash64("_i"), F.lit(chunks)).alias("_chunk")).agg(F.sort_array(F.collect_list(
        F.struct(F.col("_i").alias("i"), F.col("_t").alias("t"), F.col("_y").alias("y"), F.col("_s").alias("s")))).alias("_r"))
    # one object at a time: the chunk's rows of one (fold, split)
    each = g.select("_r", F.explode(F.array_distinct(F.flatten(F.transform("_r", lambda r: r["s"])))).alias("_k"))
    each = each.select("_k.fold", "_k.split", F.filter("_r", lambda r: F.array_contains(r["s"], F.col("_k"))).alias("_r"))
    # a file open for each (fold, split) instead of a sort of all folds' texts, which spills
    spark, name = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        (each.select(*keys, F.col("_r.t").alias("text"), F.col("_r.y").alias("labels"))
             .write.mode("overwrite").partitionBy(*keys).option("compression", "gzip").json(path))
    finally:
        spark.conf.set(name, before)


def load_fold(spark: SparkSession, path: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """A5: train and test of one fold; the filter prunes partitions."""
    d = spark.read.parquet(path).filter(F.col("fold") == fold)
    return d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")


def load_logo_fold(spark: SparkSession, path: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """A5 for leave-one-group-out tables written by ``fold`` (test group):
    test is partition ``fold``, train every other partition."""
    d = spark.read.parquet(path)
    return d.filter(F.col("fold") != fold), d.filter(F.col("fold") == fold)


def write_vectors(df: DataFrame, path: str) -> None:
    """All folds of one embedding, partitioned for pruning."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("dataset", "embedding", "fold", "split").parquet(path))


def read_vectors(spark: SparkSession, path: str, dataset: str, embedding: str) -> DataFrame:
    """The vector folds of one (dataset, embedding)."""
    return spark.read.parquet(path).filter(
        (F.col("dataset") == dataset) & (F.col("embedding") == embedding))
