"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on. AQE turns shuffle statistics
# into runtime decisions: broadcast only when the measured side is small,
# split skewed join partitions, coalesce tiny partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # file copies and deletes run inside tasks: never launch a second copy
    "spark.speculation": "false",
    # checkpoint files are removed once nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "cataloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context:
    their path doesn't hold the folder that the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_cataloom_shipped", None):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # executors fetch the archive while the context lives; it goes with this process
    sc._cataloom_shipped = made = tempfile.TemporaryDirectory(prefix="cataloom-ship-")
    copy = os.path.join(made.name, "tree", "cataloom")
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(made.name, "cataloom"), "zip", os.path.dirname(copy)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder that `DataFrame.checkpoint()` writes to.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used. Only a local-mode session without the setting (tests, the
    bench) gets a fresh private folder under the system temp dir.
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
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster run needs a shared checkpoint folder")
    folder = tempfile.mkdtemp(prefix="cataloom-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

