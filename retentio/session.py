"""Spark session helpers.

The library never builds its own session inside operators; callers pass one.
``local_session`` is for tests, the bench and the smoke entry point.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: folders of frozen tables that this process has made and not yet deleted
_SCRATCH: list[str] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "retentio") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RETENTIO_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    wins.  Only a local-mode session without one (tests) gets a private folder
    under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="retentio-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder for a frozen table below the shared checkpoint folder; it is
    deleted by ``release_scratch``, at the latest when this process ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch() -> None:
    """Delete every frozen table made so far.  DataFrames that read one can't be used afterwards."""
    jvm = SparkContext._jvm
    while _SCRATCH:
        path = _SCRATCH.pop()
        if jvm is not None:
            try:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
            except Exception:  # noqa: BLE001 - the JVM may be gone; then nothing can be deleted from here
                jvm = None


atexit.register(release_scratch)
