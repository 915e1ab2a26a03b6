"""Session helpers: a local session for tests/bench and the lineage-cut directory.

Iterative algorithms cut lineage with reliable ``DataFrame.checkpoint()`` into the
folder the cluster names in ``spark.checkpoint.dir``.  The library never invents a
machine-local folder on a cluster: when no folder is configured and the master is not
``local``, it raises instead.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "weft") -> SparkSession:
    """Session used by tests and ``bench.py`` (local mode, UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the tables of tests and bench are single files of one row group: deal their rows out
    spark.conf.set("weft.scan.partitions", str(spark.sparkContext.defaultParallelism))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it from the session if needed.

    Order: the SparkContext's current folder, then ``spark.checkpoint.dir`` from the
    session conf.  Only in local mode, when neither is set, a fresh folder under the
    system temp dir is used (tests).  On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative graph algorithms need a shared "
            "folder (HDFS/S3/...) to checkpoint into on a cluster"
        )
    path = tempfile.mkdtemp(prefix="weft-ckpt-")
    _made.append((spark, path))
    sc.setCheckpointDir(path)
    return path


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_made() -> None:
    """On exit, delete the scratch folders that this process made."""
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone; only local folders can go now
            if "://" not in path:
                shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written intermediate tables)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path
