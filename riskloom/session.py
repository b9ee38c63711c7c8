"""Spark session helpers.

The library never assumes a machine-local scratch folder on a cluster: the
checkpoint folder is whatever the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent (local tests) do we pick one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on.  AQE re-plans joins and
# coalesces shuffle partitions at run time; skew-join splits hot keys.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # AQE keeps partitions of at least this size when coalescing; small
    # but compute-heavy stages (JSON rules, trees) keep their parallelism
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
}


def build_session(master: str | None = None, app: str = "riskloom",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session builder.  On a cluster use the provided session and
    call :func:`prepare_session` instead."""
    master = master or os.environ.get("RISKLOOM_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEM", "16g"))
          .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the time zone the timestamp rules assume (UTC).  Cluster settings
    win: nothing else that is set is overridden."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.
    A temporary folder stands in only on a single-machine ``local[..]`` master
    (tests); on a cluster an unset folder is an error, because each executor
    would write to a disk of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskloom-{tag}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its
    plan ends there, later readers and lost executors re-read the table."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per application),
    so that they need neither the driver's working directory nor an install."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="riskloom-ship-"), "riskloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("riskloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
