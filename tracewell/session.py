"""Session settings shared by tests, the bench and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

HOT_ROWS_CONF = "spark.tracewell.hotRows"
CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tracewell") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, skew joins)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp"))
        .getOrCreate()
    )


def hot_rows(spark: SparkSession) -> int:
    """Rows one key may hold before ordered operators split it into ranges."""
    return int(spark.conf.get(HOT_ROWS_CONF, "2000000"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; set one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running iterative jobs")
        shared = tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")
    sc.setCheckpointDir(shared)
