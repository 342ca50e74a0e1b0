"""Session helpers: a local session for tests/bench and the shared work dir."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "rarefold") -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench)."""
    master = master or os.environ.get("RAREFOLD_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rarefold`` importable by Python workers wherever they run.

    Task closures and broadcast models refer to this package, so it is zipped
    (in memory) once per SparkContext, written to the shared folder through
    Hadoop's file system API and handed to ``addPyFile`` from there (Spark
    serves it to every executor, as ``--py-files`` would). No machine-local
    folder is involved."""
    import io
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(pkg):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    path = f"{_checkpoint_dir(spark).rstrip('/')}/rarefold-pyfiles/{uuid.uuid4().hex[:12]}/rarefold.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(str(fs.makeQualified(hpath).toString()))
    _SHIPPED.add(key)


def _checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session names it. A local session without
    one gets a fresh folder; on a cluster it must be set, because a machine-local
    folder would not be shared."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="rarefold-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir`` (read from
    the session), with the package shipped to the workers."""
    d = _checkpoint_dir(spark)
    ship_package(spark)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for written tables."""
    return f"{shared_dir(spark).rstrip('/')}/rarefold/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Cut lineage: write ``df`` as parquet under the shared folder and read it
    back. Unlike ``checkpoint()``, the re-read table starts from its real file
    size, so size estimates of iterative plans cannot compound, and it survives
    lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._rarefold_path = path   # for ``release``
    return out


#: Bytes of rows that go to a Python worker at a time.
ARROW_BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``ARROW_BATCH`` bytes (one longer row is a batch
    of its own), so that a worker's memory does not grow with the rows of its task.
    Spark's own bound is 64 MB; a session that asks for less keeps its bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark.conf.get(name, "64m").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(most[-1:], 0)
    n = int(most[:-1]) * unit if unit else int(most)
    if n <= 0 or n > ARROW_BATCH:
        spark.conf.set(name, f"{ARROW_BATCH}b")


def row_join(left, right, on, how: str = "inner"):
    """A join of two tables that both grow with the data. Written id tables are small
    as files and Spark would plan to send them through the driver; the hint deals
    both sides instead."""
    return left.join(right.hint("merge"), on=on, how=how)


def release(*dfs) -> None:
    """Delete tables written by ``materialize`` once nothing will read them
    again (loops would otherwise leave one copy per iteration in the shared
    folder). Frames that were not written by ``materialize`` are ignored."""
    for df in dfs:
        path = getattr(df, "_rarefold_path", None)
        if not path:
            continue
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        df._rarefold_path = None


def spread(df, key: str):
    """Hash-spread ``df`` by ``key`` over ``rarefold.spread.partitions`` before
    CPU-heavy work on its rows. The session setting is off (0) by default: input
    that Spark can split needs no shuffle. Set it for input that it cannot split,
    such as one file with one row group."""
    n = int(df.sparkSession.conf.get("rarefold.spread.partitions", "0"))
    return df.repartition(n, key) if n else df
