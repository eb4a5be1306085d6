"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on: UTC for date arithmetic, AQE for runtime re-planning
# (partition coalescing, skew-join splitting, broadcast demotion of small sides).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Starting points for a large cluster (hundreds of executors, tens of TB per job): start
# fine-grained and let AQE coalesce to ~256 MB partitions, split skewed join partitions, and
# keep the broadcast threshold moderate (every broadcast is also bounded by a row count or a
# fixed-size dimension in this library).
CLUSTER_CONF = {
    **SESSION_CONF,
    "spark.sql.shuffle.partitions": "8192",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Folders per year that the users are dealt over; a store keeps its number.
    "spendlens.user.buckets": "1024",
}


def apply_cluster_conf(spark: SparkSession) -> None:
    """Apply CLUSTER_CONF's runtime SQL settings to a session."""
    for k, v in CLUSTER_CONF.items():
        spark.conf.set(k, v)


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "spendlens") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPENDLENS_DRIVER_MEMORY", "8g"))
    )
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Pin the runtime SQL settings on an existing session (e.g. one a driver built)."""
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)


def _is_local(spark: SparkSession) -> bool:
    """One JVM for driver and executors: local, local[n], not local-cluster."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a folder that all executors share: without it this raises,
    as a private folder would be another one on each machine. Only in a local session, as in
    tests, a private folder is created and registered.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spendlens-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_CLEANED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one; it is removed when the driver ends."""
    root = f"{checkpoint_root(spark)}/spendlens/{spark.sparkContext.applicationId}"
    if root not in _CLEANED:
        _CLEANED.add(root)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path for intermediate tables, gone when the driver ends."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
