"""Session helpers: the one place that knows about configuration.

Library functions never create a session; they take DataFrames. These helpers
are for entry points, tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SCALE_CONF = {
    # Adaptive execution: coalesce small shuffle partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Bounded broadcast: only sides the planner proves small are broadcast.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "issuelens", extra: dict | None = None) -> SparkSession:
    """A session with the engine's scale settings (tests, bench, CLI)."""
    master = master or os.environ.get("ISSUELENS_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("ISSUELENS_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset.

    On a cluster the setting names a shared folder and is left alone. Only a
    local session without it (tests) gets a fresh scratch folder; a cluster
    without one is an error, as executors could not see a local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="issuelens-ckpt-")
    sc.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed there.

    Spark's own file server hands a zip of the sources to the executors, once
    for each session. Installed packages, and sessions whose workers find the
    sources by PYTHONPATH or the working folder, are left alone.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    if root in paths or "site-packages" in root or getattr(spark, "_issuelens_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="issuelens-src-"), "issuelens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "issuelens")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    spark._issuelens_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back: later steps neither make them again nor guess their size."""
    path = scratch_table_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def together(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of a key in one task, as many tasks as the session shuffles into whatever their bytes.

    Whole rows are dealt out, so that what is exploded from them needs no shuffle to be grouped by the key and more.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def scratch_table_dir(spark: SparkSession, name: str) -> str:
    """A folder under the checkpoint dir for tables written to cut lineage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"
