"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROWS_PER_TASK = 500_000     # rows of a shuffled table that one task sorts or adds up
TASK_BYTES = "16m"          # shuffled or scanned bytes that go into one task


def get_spark(master: str | None = None, app: str = "cohortlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and the UI off; reuses a running session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Uses ``spark.checkpoint.dir`` / the context's checkpoint dir when the
    cluster names one; only a local session without one (a test) gets a fresh
    scratch folder. A cluster without one is an error: its executors share no
    local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/cohortlens-{spark.sparkContext.applicationId}"


def write_stage(df, name: str):
    """Write ``df`` as Parquet in the shared folder and read it back.

    Like a checkpoint it cuts the lineage; unlike one it is columnar, so later
    steps read the columns they need and the planner knows sizes.
    """
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int):
    """Shuffles that run inside have partitions in proportion to ``rows``, so a task's memory does not grow with them.

    Never fewer than the session has; its settings stand again afterwards.
    """
    sized = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))),
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.files.maxPartitionBytes": TASK_BYTES}
    before = {k: spark.conf.get(k, None) for k in sized}
    for k, v in sized.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_stages(spark: SparkSession) -> None:
    """Remove all stage folders of this application."""
    p, fs = _file_system(spark, stage_root(spark))
    fs.delete(p, True)


def data_version(spark: SparkSession, data_dir: str) -> tuple:
    """Name, size and time of what lies in ``data_dir``; changes when a table is replaced."""
    p, fs = _file_system(spark, data_dir)
    if not fs.exists(p):
        return ()
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cohortlens`` importable in the Python workers (once per application).

    Operators that run numpy inside tasks (mapInPandas / applyInPandas) call
    package helpers on the executors; the package is zipped on the driver and
    distributed with ``SparkContext.addPyFile``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    import cohortlens
    pkg_dir = os.path.dirname(os.path.abspath(cohortlens.__file__))
    base = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="cohortlens-pyfiles-"), "cohortlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
