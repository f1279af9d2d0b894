"""Session helpers: one place for the settings every job in the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one with the library's defaults.

    On a cluster the platform builds the session; this only fills in settings that are unset.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = (
        SparkSession.builder.master(master or os.environ.get("TABLEVAULT_MASTER", "local[8]"))
        .appName("tablevault")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and we use it as given. Only a local session (tests,
    laptop runs) with the setting unset gets a folder of our own; a cluster session without it is
    an error, because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path:
        return path
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="tablevault-ckpt-")
    sc.setCheckpointDir(path)
    return path


#: Bytes of rows in one Arrow batch on its way to Python, where text takes several times its size.
ARROW_BATCH_BYTES = 2 << 20


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound the memory that rows of any length take on their way to Python, unless the session says otherwise.

    Spark's own bounds are 10,000 rows, whatever their length, and 64 MiB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(ARROW_BATCH_BYTES))
